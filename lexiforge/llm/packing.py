"""Concatenate and cut: documents as one stream of token ids, cut into windows of a fixed length.

Two passes. The first one encodes each document where it lies, closes it with the end id and writes the ids with
the place that they have among those of their task. The totals of the tasks, one row each, are summed up, which
gives every task, and so every document, its offset in the whole stream. The second pass reads the ids and cuts
them at multiples of the length: a window that one task holds whole is a sequence; what lies at a task's two ends
is a boundary record (two a task at most), and the records of one window, at most `length` ids, are joined by its number.
All sequences but the last are full, so what is padded is less than one sequence in the whole corpus.

Nothing moves but boundary records. A task holds one batch of texts and one window. A lost executor repeats tasks of
one pass; the places come from what the first pass wrote, so that a second attempt can't shift them.

Encoding: no piece of this make of tokenizer goes on from a character to white space behind it, nor from a letter or
digit to a mark behind it, so texts are cut there, all of a slice at once, as Arrow arrays on the same bytes. Each spelling
of a slice is looked up once: those seen before come from a bounded memo, new ones are cut into the tokenizer's pieces and
encoded by its model. A text with white space beyond ASCII, with one of the model's special tokens, or any text for
another make of tokenizer, is encoded whole.

Rows: a null or empty text gives the end id alone. Rows are documents of their own, whatever their doc_id (null or
repeated, too). Other columns are ignored. An empty table gives no sequence.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm._shared import fresh_path

LENGTH, END_ID = 1024, 0
#: Spellings that a worker remembers, and the longest one, in characters.
MEMO, LONGEST = 800_000, 48
#: Bytes of ids in one batch of rows that a task returns.
BATCH = 8 << 20
#: Bytes of text (or one text) that are encoded at once, and their parts that are looked up at once.
SLICE, LOOKUP = 8 << 20, 1 << 21
#: Letters, numbers and all characters that `PIECE` knows; what else counts as white space to the tokenizer
#: or to Python; and what each byte of a text is.
LETTERS, NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+").findall
WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\u00a1-\u017f\u2010-\u2027\u20ac]*").fullmatch
OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE, LETTER, MARK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[33:127] = MARK
KIND[[i for i in range(128) if chr(i).isalnum()]] = LETTER

ID = attrgetter("id")
PIECES = "array<struct<doc_id:{id},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.whole.to_str())
        cut = spec.get("pre_tokenizer") or {}
        self.known = spec.get("normalizer") is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        self.odd = "|".join([OTHER_SPACE, *(re.escape(x["content"]) for x in spec["added_tokens"])])
        self.is_odd = re.compile(self.odd).search
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        hidden = iter(range(256, 512))
        self.byte = [chr(b if b in shown else next(hidden)) for b in range(256)].__getitem__
        self.model = self.whole.model
        self.memo: dict[str, bytes] = {}

    def _new(self, parts: list[str], odd: bool) -> list[bytes]:
        ids: list[int] = []
        ends = [0]
        for x in parts:
            if self.known and (WORD(x) or PLAIN(x)) and not (odd and self.is_odd(x)):
                for piece in (x,) if WORD(x) else PIECE(x):
                    ids.extend(map(ID, self.model.tokenize("".join(map(self.byte, piece.encode())))))
            else:
                ids += self.whole.encode(x, add_special_tokens=False).ids
            ends.append(len(ids))
        size, raw = self.dtype.itemsize, np.array(ids, self.dtype).tobytes()
        made = [raw[size * i : size * k] for i, k in pairwise(ends)]
        room = max(0, MEMO - len(self.memo))
        self.memo.update(islice(((x, y) for x, y in zip(parts, made, strict=True) if len(x) <= LONGEST), room))
        return made

    def _parts(self, texts: pa.LargeStringArray, odd: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The texts' parts, on the same bytes (odd texts are whole), and the number of parts before each text and in all."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = pa.py_buffer(b"") if texts.buffers()[2] is None else texts.buffers()[2].slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        b, cut = np.frombuffer(raw, np.uint8), np.zeros(ends[-1] + 1, bool)
        kind = KIND[b]
        space, letter = kind == SPACE, kind == LETTER
        letter[1:] |= (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)  # U+00C0 to U+00FF but for two signs
        cut[1:-1] = (space[1:] & ~space[:-1]) | ((kind[1:] == MARK) & letter[:-1])
        for i in np.flatnonzero(odd):
            cut[ends[i] : ends[i + 1]] = False
        cut[ends] = True
        at = np.flatnonzero(cut)
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), raw), np.searchsorted(at, ends)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one text's after the other's, and how many each text has."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.known else np.ones(len(texts), bool)
        parts, before = self._parts(texts, odd)
        made, counts = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        for i in range(0, len(parts), LOOKUP):
            met = parts.slice(i, LOOKUP).dictionary_encode()
            spelt = met.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.memo.get, spelt))
            new = [k for k, x in enumerate(found) if x is None]
            for k, x in zip(new, self._new([spelt[k] for k in new], odd.any()), strict=True):
                found[k] = x
            ids = np.frombuffer(b"".join(found), self.dtype)
            n = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            which = met.indices.to_numpy()
            count = n[which]
            # where each part's ids begin, less the place where they go
            shift = (np.cumsum(n) - n)[which] - (np.cumsum(count) - count)
            made.append(ids[np.repeat(shift, count) + np.arange(count.sum())])
            counts.append(count)
        return np.concatenate(made), np.diff(np.cumsum(np.concatenate(counts))[before])

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (ids of the part's documents before this one), n, ids, wide: written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        size = encode.dtype.itemsize
        for batch in batches:
            upto, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64), 0
            while first < batch.num_rows:
                past = int(upto[first - 1]) if first else 0
                to = max(first + 1, int(np.searchsorted(upto, past + SLICE, "right")))
                doc_id, texts = (batch.column(i).slice(first, to - first) for i in (0, 1))
                ids, n = encode.batch(texts)
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                offsets = np.concatenate([[0], ends * size]).astype(np.int32)
                own = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                columns = [doc_id, pa.array(np.full(len(n), part, np.int64)), pa.array(before + ends - n), pa.array(n), own, pa.array(np.full(len(n), size == 4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n", "ids", "wide"])
                before, first = before + int(ends[-1]), to

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _written(rows.mapInArrow(run, f"doc_id {kind}, part long, before long, n long, ids binary, wide boolean"), "encoded")


def _written(df: DataFrame, name: str) -> DataFrame:
    """As `saved`; ids are small numbers, which zstd halves."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fragments(ids: DataFrame, bases: dict[int, int], total: int, length: int) -> DataFrame:
    """sequence_id, place, whole, ids, pieces: what each task holds of each window."""
    kind = ids.schema["doc_id"].dataType.simpleString()
    pieces = PIECES.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[str, list] = {k: [] for k in ("sequence_id", "place", "whole", "ids", "pieces")}
        held: list[np.ndarray] = []  # ids of the open window
        own: list[dict] = []  # and its pieces
        window = place = stop = 0  # its number, its first id in the window, and where the stream goes on
        schema = None

        def close() -> None:
            if not own:
                return
            n = stop - window * length - place
            done["sequence_id"].append(window)
            done["place"].append(place)
            done["whole"].append(place == 0 and (n == length or stop == total))
            done["ids"].append(np.concatenate(held).tobytes())
            done["pieces"].append(own.copy())
            held.clear()
            own.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({k: list(v) for k, v in done.items()}, schema=schema)
            for v in done.values():
                v.clear()
            return out

        for batch in batches:
            if schema is None:
                piece = pa.struct([("doc_id", batch.schema.field("doc_id").type), *((k, pa.int64()) for k in ("start", "length", "doc_tokens", "offset"))])
                schema = pa.schema([("sequence_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("ids", pa.binary()), ("pieces", pa.list_(piece))])
            doc_ids = batch.column("doc_id").to_pylist()
            parts, befores = batch.column("part").to_pylist(), batch.column("before").to_pylist()
            for doc_id, part, before, raw, wide in zip(doc_ids, parts, befores, batch.column("ids"), batch.column("wide").to_pylist(), strict=True):
                stream = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2")
                n, at, g = len(stream), 0, bases[part] + before
                if g != stop:  # another task's documents lie between
                    close()
                    stop = g
                while at < n:
                    if not own:
                        window, place = divmod(stop, length)
                    take = min(n - at, (window + 1) * length - stop)
                    held.append(stream[at : at + take].astype("<u4"))
                    own.append({"doc_id": doc_id, "start": at, "length": take, "doc_tokens": n, "offset": stop - window * length})
                    at, stop = at + take, stop + take
                    if stop == (window + 1) * length:
                        close()
                        if len(done["ids"]) * length * 4 >= BATCH:
                            yield batch_of()
        close()
        if schema is not None and done["ids"]:
            yield batch_of()

    return ids.select("doc_id", "part", "before", "ids", "wide").mapInArrow(run, f"sequence_id long, place long, whole boolean, ids binary, pieces {pieces}")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The sequences: sequence_id (from 0, in the stream's order), n_tokens, padded_to, ids (little-endian unsigned
    32-bit integers), and pieces, in order: doc_id, start (ids of its document before it), length, doc_tokens,
    offset (in the sequence). What comes to the driver is one row a task."""
    ids = encoded(docs, tokenizer, end_id)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in totals:
        bases[r.part], total = total, total + r.n
    cut = _written(_fragments(ids, bases, total, length), "windows")
    fragments = F.array_sort(F.collect_list(F.struct("place", "ids", "pieces")))
    met = cut.where("NOT whole").groupBy("sequence_id").agg(fragments.alias("f")).select(
        "sequence_id", F.aggregate("f", F.lit(b""), lambda a, f: F.concat(a, f["ids"])).alias("ids"), F.flatten(F.col("f")["pieces"]).alias("pieces")
    )
    out = cut.where("whole").select("sequence_id", "ids", "pieces").unionByName(_written(met, "boundaries"))
    n = F.expr("octet_length(ids) div 4")
    return out.select("sequence_id", n.alias("n_tokens"), F.when(F.bit_count(n) == 1, n).otherwise(length).alias("padded_to"), "ids", "pieces")


def padded(sequences: DataFrame, pad_id: int = END_ID) -> DataFrame:
    """sequences, each filled up with pad_id to its padded_to."""
    fill = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.col("padded_to") - F.col("n_tokens")).cast("int"))
    return sequences.withColumn("ids", F.concat("ids", F.unhex(fill)))


def pieces_of(sequences: DataFrame) -> DataFrame:
    """One row a piece, with the crc32 of its ids as they lie in the sequence."""
    rows = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.offset + 1 AS int), cast(4 * p.length AS int))")
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
