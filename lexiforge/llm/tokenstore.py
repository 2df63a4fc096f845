"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A store is a folder of shards, each of two files, and a manifest. Documents lie in ascending order of doc_id
(nulls first; equal ids by the hash of their text). `*.ids` holds raw little-endian ids and nothing else, two
bytes each if the vocabulary allows it, else four. `*.idx` (numpy arrays, .npz) has a row for each document,
and the index: a minimal perfect hash of the shard's different doc_ids, which gives each its own slot, and in
the slot the key's fingerprint, its offset and its length. The hash is a cascade of bit arrays: a key that is
alone at its place in a level is settled there, the others go on to the next level; its slot is the number of
bits set before its own. A shard's range of keys is in the manifest, so a lookup is one search among shards
and one probe a level (1.6 on average).

Shards are written by tasks under names of their own attempt, and the manifest names the files of the attempts
that counted: a lost executor or a second attempt leaves unread files at worst. Files go through
pyarrow.fs, so the folder may be on any store that it reaches (local or mounted paths, s3, gs, hdfs).

Encoding uses the tokenizers library. Words of plain Latin text come from a bounded memo of the model's own
tokens; a text with any other character, or with the spelling of a special token, is encoded whole.

Rows: a null text is empty and holds the end id alone. Null ids are stored, but have no key; of repeated ids
the first one has the key. Extra columns are ignored. An empty table gives a store without shards.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm._shared import fresh_path, numbered, saved

END_ID = 2
#: Text bytes of a shard, about.
SHARD_TEXT = 32 << 20
#: Words and tokens that a worker remembers.
MEMO = 400_000
READ = 8 << 20
#: Fixed value: how the tokenizer that `Encoder` knows cuts words.
PRE_TOKENIZERS = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]
#: Shards that a store keeps open.
OPEN = 64


# --- encoding ---------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: The memo knows this one make of tokenizer; others encode every text whole.
        cuts = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.known = (kinds, cuts, spec["model"].get("end_of_word_suffix")) == (["NFC", "Replace", "Lowercase"], PRE_TOKENIZERS, "</w>")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        # Latin letters that lower-case alike everywhere and compose with nothing; white space and marks that go by class
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž–—‘’“”…€]*").fullmatch
        letters, numbers = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
        self.pieces = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.words, self.parts = _Memo(self._word), _Memo(self._part)

    def _part(self, piece: str) -> bytes:
        tokens = self.whole.model.tokenize(piece.encode().decode("latin-1").translate(self.byte))
        return np.array([t.id for t in tokens], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([self.parts[x] for x in self.pieces(word)])

    def __call__(self, text: str) -> bytes:
        if self.known and self.plain(text) and not self.special.search(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < MEMO:
            self[key] = value
        return value


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- minimal perfect hash ---------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of the hash of different keys: sizes, and all levels' bits in one array. Mixing is a bijection of
    64 bits, so different keys part at some level."""
    sizes, levels, left = [], [], keys
    while len(left):
        size = max(64, len(left) * 2)
        at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(levels) if levels else np.empty(0, bool)
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(bits, bitorder="little"), "n_bits": np.array([len(bits)], np.int64)}


class Hash:
    def __init__(self, made: dict[str, np.ndarray]):
        self.sizes = made["sizes"]
        self.bits = np.unpackbits(made["bits"], bitorder="little", count=int(made["n_bits"][0])).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that the hash wasn't built for, any slot or -1."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64) + base
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


# --- files ------------------------------------------------------------------------------------------------


def files(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)


class Shard:
    """Keyed and ordered access to one shard of a store."""

    def __init__(self, folder: str, entry: dict):
        self.fs, top = files(folder)
        self.path, self.entry = f"{top}/{entry['name']}", entry
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            made = np.load(io.BytesIO(f.read()))
            self.rows = {k: made[k] for k in ("doc_id", "null", "length")}
            self.slot = {k: made[k] for k in ("fingerprint", "offset", "slot_length")}
            self.hash = Hash({k: made[k] for k in ("sizes", "bits", "n_bits")})
        self.offsets = np.cumsum(self.rows["length"]) - self.rows["length"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset (in ids, -1 if absent) and length of each key."""
        slot = self.hash.slots(keys)
        there = (slot >= 0) & (len(self.slot["offset"]) > 0)
        slot = np.where(there, slot, 0)
        if not there.any():
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        there &= self.slot["fingerprint"][slot] == fingerprint(keys)
        return np.where(there, self.slot["offset"][slot], -1), np.where(there, self.slot["slot_length"][slot], 0)

    def ids(self, offset: int, length: int) -> np.ndarray:
        size = self.entry["width"]
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            raw = f.read_at(length * size, offset * size)
        return np.frombuffer(raw, f"<u{size}").astype("<u4")


class Store:
    """A written store: get(doc_id) gives a document's ids."""

    def __init__(self, folder: str):
        self.folder = folder
        fs, top = files(folder)
        with fs.open_input_file(f"{top}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.entries = [x for x in self.manifest["shards"] if x["first"] is not None]
        self.lasts = [x["last"] for x in self.entries]
        self.open_: OrderedDict[str, Shard] = OrderedDict()

    def shard(self, entry: dict) -> Shard:
        """A shard's index, read once while it is among the last OPEN ones used."""
        if entry["name"] not in self.open_:
            self.open_[entry["name"]] = Shard(self.folder, entry)
        self.open_.move_to_end(entry["name"])
        if len(self.open_) > OPEN:
            self.open_.popitem(last=False)
        return self.open_[entry["name"]]

    def get(self, doc_id: int) -> np.ndarray | None:
        # a key that repeats may go on in later shards; its first one has it
        for entry in self.entries[bisect_left(self.lasts, doc_id) :]:
            if entry["first"] > doc_id:
                return None
            offset, length = self.shard(entry).find(np.array([doc_id], np.int64))
            if offset[0] >= 0:
                return self.shard(entry).ids(int(offset[0]), int(length[0]))
        return None


# --- the operator -----------------------------------------------------------------------------------------

WROTE = "name string, first long, last long, docs long, ids long, width int"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_text: int = SHARD_TEXT) -> dict:
    """Writes a store; returns its manifest. What comes to the driver is one row a shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    alike = rows.groupBy("doc_id", "h").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    whole = alike.agg(F.sum("b").alias("b"), F.max(F.when(F.col("n") > 1, F.col("b"))).alias("most")).first()
    order = ["doc_id", "h"]
    if (whole["most"] or 0) > shard_text:  # rows that repeat beyond a shard: their numbers deal them on
        rows, order = numbered(rows, ["doc_id", "h"], "nth"), [*order, "nth"]
    dealt = rows.repartitionByRange(max(1, -(-(whole["b"] or 0) // shard_text)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, top) = encoder(tokenizer), files(folder)
        end = np.array([end_id], encode.dtype).tobytes()
        name, out, ids, nulls, lengths = f"shard-{uuid.uuid4().hex}", None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{top}/{name}.ids")
            null = np.asarray(batch.column(0).is_null())
            ids.append(batch.column(0).fill_null(0).to_numpy())
            nulls.append(null)
            length = np.empty(batch.num_rows, np.int64)
            for i, x in enumerate(batch.column(1)):
                raw = encode(x.as_py()) + end
                length[i] = len(raw) // encode.dtype.itemsize
                out.write(raw)
            lengths.append(length)
        if out is None:
            return
        out.close()
        doc_id, null, length = (np.concatenate(x) for x in (ids, nulls, lengths))
        offset = np.cumsum(length) - length
        keys, first = np.unique(doc_id[~null], return_index=True)
        made = build(keys)
        slot = np.argsort(Hash(made).slots(keys))
        where = np.flatnonzero(~null)[first][slot]
        index = io.BytesIO()
        np.savez(index, doc_id=doc_id, null=null, length=length, fingerprint=fingerprint(keys[slot]), offset=offset[where], slot_length=length[where], **made)
        with fs.open_output_stream(f"{top}/{name}.idx") as f:
            f.write(index.getvalue())
        span = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        yield pa.RecordBatch.from_pylist(
            [{"name": name, "first": span[0], "last": span[1], "docs": len(doc_id), "ids": int(length.sum()), "width": encode.dtype.itemsize}],
            schema=pa.schema([("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]),
        )

    place = F.spark_partition_id().alias("place")
    wrote = saved(dealt.mapInArrow(run, WROTE).select("*", place), "shards").collect()
    shards, start = [], 0
    for r in sorted(wrote, key=lambda r: r.place):
        entry = r.asDict() | {"start": start}
        start += entry["ids"]
        shards.append(entry)
    manifest = {"end_id": end_id, "shards": shards}
    fs, top = files(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_back(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, keyed (the index gave this row): one row a document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, keyed boolean"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    entries = spark.createDataFrame([(json.dumps(x),) for x in manifest["shards"]], "entry string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                entry = json.loads(x)
                shard = Shard(folder, entry)
                doc_id, null = shard.rows["doc_id"], shard.rows["null"]
                # the key's first row comes from the index; rows without a key, and those that repeat one, in their order
                keyed = ~null & np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | null[:-1]])
                offset, length = shard.offsets.copy(), shard.rows["length"].copy()
                offset[keyed], length[keyed] = shard.find(doc_id[keyed])
                if (offset < 0).any():
                    raise ValueError(f"the index of {entry['name']} doesn't hold {doc_id[offset < 0][0]}")
                size, crc = entry["width"], np.empty(len(doc_id), np.int64)
                with shard.fs.open_input_file(f"{shard.path}.ids") as f:
                    at = 0
                    while at < len(doc_id):  # neighbours in one read, up to READ bytes or one document
                        to = max(at + 1, int(np.searchsorted(offset, offset[at] + READ // size)))
                        base = int(offset[at])
                        raw = np.frombuffer(f.read_at(int(length[at:to].sum()) * size, base * size), f"<u{size}").astype("<u4")
                        for i in range(at, to):
                            crc[i] = zlib.crc32(raw[offset[i] - base : offset[i] - base + length[i]])
                        at = to
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64(), mask=null), pa.array(offset + entry["start"]), pa.array(length), pa.array(crc), pa.array(keyed)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "keyed"],
                )

    return entries.repartition(len(manifest["shards"])).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs as a store in the shared folder and reads it back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "store")
    return read_back(spark, folder, write(docs, folder, tokenizer))
