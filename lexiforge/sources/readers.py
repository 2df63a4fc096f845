"""Readers by file type, and the router that gives each file to its own; what can't be read becomes a reject."""

from __future__ import annotations

import csv
import io
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.operators import chunking, markdown
from lexiforge.sources import pdf as pdfs
from lexiforge.sources.shared import written

TEXTS, MARKDOWNS, TABLES, PICTURES = ("txt",), ("md", "markdown"), ("csv",), ("jpg", "jpeg", "png", "gif", "bmp", "webp")
CHUNKS = ["path", "chunk_index", "text", "start_offset", "end_offset", "tags", "urls", "section_header", "section_hierarchy", "url_contexts", "topics", "summary"]


def routed(files: DataFrame) -> DataFrame:
    """files with kind: text, markdown, csv, pdf, image, or unsupported."""
    ext = t.extension(F.col("path"))
    kind = F.when(ext.isin(*TEXTS), "text").when(ext.isin(*MARKDOWNS), "markdown").when(ext.isin(*TABLES), "csv").when(ext == "pdf", "pdf").when(ext.isin(*PICTURES), "image")
    return files.withColumn("kind", kind.otherwise("unsupported"))


def decoded(files: DataFrame) -> DataFrame:
    """files with text, null where the bytes aren't UTF-8."""
    return files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))


def csv_tables(files: DataFrame) -> DataFrame:
    """path, text (rows as lines of comma-joined cells), header_fields, row_count. Cells may hold line ends, so a
    file is parsed as one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [list(csv.reader(io.StringIO(x, newline=""))) for x in part["text"].fillna("")]
            yield pd.DataFrame({
                "path": part["path"].to_numpy(), "text": ["\n".join(",".join(r) for r in own) for own in rows],
                "header_fields": [own[0] if own else [] for own in rows], "row_count": [max(len(own) - 1, 0) for own in rows],
            })

    return files.select("path", "text").mapInPandas(run, "path string, text string, header_fields array<string>, row_count int")


def _whole(chunks: DataFrame) -> DataFrame:
    strings = {"tags": F.lit(""), "section_header": F.lit(""), "section_hierarchy": F.array().cast("array<string>")}
    return chunks.select(*[F.col(c) if c in chunks.columns else strings[c].alias(c) for c in CHUNKS])


PdfParser = Callable[[bytes], list[tuple[int, int, int, int, str, float, int, float]]]
Captioner = Callable[[bytes], str]
#: The first chunk number of a PDF's pictures; those of its text are below.
PICTURE_CHUNKS = 1_000_000


def captions(files: DataFrame, model: Captioner) -> DataFrame:
    """path, text of pictures, and the facts about them; a picture that can't be read, or for which the model fails or
    says nothing, has a problem and no text."""
    kept = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                try:
                    facts = image_facts(bytes(content))
                    text = model(bytes(content))
                    rows.append((text or None, *facts, None if text else "no caption"))
                except Exception as x:  # noqa: BLE001  models raise what they like; it costs this picture alone
                    rows.append((None, None, None, None, None, str(x) or type(x).__name__))
            made = pd.DataFrame(rows, columns=["text", "image_format", "image_width", "image_height", "color_profile", "problem"])
            made[["image_width", "image_height"]] = made[["image_width", "image_height"]].astype("Int32")
            yield pd.concat([part[kept].reset_index(drop=True), made], axis=1)

    return files.mapInPandas(run, schema + ", text string, image_format string, image_width int, image_height int, color_profile string, problem string")


def image_facts(content: bytes) -> tuple[str, int, int, str]:
    """Format, width, height and mode of a picture, from its first bytes; an error if it is none of the known kinds."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, _, kind = struct.unpack(">IIBB", content[16:26])
        return "PNG", width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")
    if content[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", *struct.unpack("<HH", content[6:10]), "P"
    if content[:2] == b"BM":
        width, height, _, bits = struct.unpack("<iiHH", content[18:30])
        return "BMP", width, abs(height), "RGBA" if bits == 32 else "RGB" if bits > 8 else "P"
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        if content[12:16] == b"VP8X":
            return "WEBP", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little"), "RGBA" if content[20] & 16 else "RGB"
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
        width, height = struct.unpack("<HH", content[26:30])
        return "WEBP", width & 0x3FFF, height & 0x3FFF, "RGB"
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content):  # JPEG: segments up to the one of the frame
        if content[at] != 0xFF:
            break
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack(">HHB", content[at + 5 : at + 10])
            return "JPEG", width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(channels, "?")
        at += 2 + size
    raise ValueError("not a known kind of picture, or cut short")


def images(spark, path: str) -> DataFrame:
    """path, image_width, image_height, channels of the images under path."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path)
    return raw.select(F.col("image.origin").alias("path"), F.col("image.width").alias("image_width"), F.col("image.height").alias("image_height"), F.col("image.nChannels").alias("channels"))


def chunked(files: DataFrame, sizes: dict[str, int] | None = None, pdf: PdfParser | None = pdfs.spans_of, caption: Captioner | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of all files, and rejects (path, checksum, stage, reason). files: path, checksum, content. PDF files are
    read by `pdf`; with a captioner, images and the pictures in PDF files become chunks, too."""
    own = decoded(routed(files))
    sizes = sizes or {}
    readable = own.where("text IS NOT NULL")
    parts = [_whole(chunking.text_chunks(readable.where("kind = 'text'"), "path", **sizes))]
    parts.append(_whole(markdown.chunks(readable.where("kind = 'markdown'"), "path")))
    parts.append(_whole(chunking.text_chunks(csv_tables(readable.where("kind = 'csv'")), "path", kind="cell", **sizes)))
    reason = F.when(F.col("kind") == "unsupported", "unsupported file type")
    refused = []
    if pdf is not None:
        read = written(pdfs.spans(own.where("kind = 'pdf'"), pdf), "spans")  # once, for chunks and for rejects
        refused.append(read.where("problem IS NOT NULL").select(F.col("doc").alias("path"), "problem"))
        made = markdown.spans_to_markdown(read.where("problem IS NULL").drop("problem"))
        blocks = markdown.header_blocks(made.withColumnRenamed("doc", "path"), "path", "markdown", sizes.get("max_size", 2048))
        empty = F.array().cast("array<struct<url:string,context:string>>")
        parts.append(_whole(blocks.select("*", F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit("").alias("urls"), empty.alias("url_contexts"), F.array(F.lit("Unknown")).alias("topics"))))
    else:
        reason = reason.when(F.col("kind") == "pdf", "no PDF parser")
    if caption is not None:
        said = written(captions(own.where("kind = 'image'").select("path", "content"), caption), "captions")
        refused.append(said.where("problem IS NOT NULL").select("path", "problem"))
        parts.append(_whole(chunking.text_chunks(said.where("problem IS NULL"), "path", **sizes)))
        if pdf is not None:
            inside = pdfs.pictures(own.where("kind = 'pdf'")).where("content IS NOT NULL")
            said = captions(inside.select(F.struct("path", "page", "number").alias("picture"), "content"), caption).where("problem IS NULL")
            place = F.col("picture.page") * 1000 + F.col("picture.number")  # a caption that is long has chunks of its own
            shown = chunking.text_chunks(said, "picture", **sizes).withColumn("chunk_index", F.lit(PICTURE_CHUNKS) + place * 100 + F.col("chunk_index"))
            parts.append(_whole(shown.withColumn("path", F.col("picture.path"))))
    else:
        reason = reason.when(F.col("kind") == "image", "no image model")
    reason = reason.when(F.col("kind").isin("text", "markdown", "csv") & F.col("text").isNull(), "not UTF-8")
    for i, r in enumerate(refused):
        own = own.join(r.groupBy("path").agg(F.min("problem").alias(f"said_{i}")), "path", "left")
        reason = F.coalesce(reason, F.col(f"said_{i}"))
    rejects = own.select("path", "checksum", F.lit("parse").alias("stage"), reason.alias("reason")).where("reason IS NOT NULL")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, rejects
