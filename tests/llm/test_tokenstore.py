import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexiforge.llm import tokenstore
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(docs):
    rows = sorted(docs.select("doc_id", "text", "h").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_round_trip(spark, tmp_path, monkeypatch):
    odd = ["á İstanbul ΣΑΣ", "<|endoftext|> x", "don't we'll 12³ ½", "\x1c\x85 a", "\U0001f600", "ª º ŉ ſ"]
    docs = cases.frame(spark).select("doc_id", "text").union(spark.read.parquet(f"{cases.SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    docs = docs.union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], docs.schema))
    hashed = docs.selectExpr("*", "xxhash64(coalesce(text, '')) AS h")
    folder = str(tmp_path / "store")
    manifest = tokenstore.write(docs, folder, PATH, shard_text=100_000)
    assert len(manifest["shards"]) > 3
    back = tokenstore.read_back(spark, folder, manifest)
    assert got(back) == want(hashed)
    assert back.where("keyed").count() == docs.select("doc_id").distinct().where("doc_id IS NOT NULL").count()
    store = tokenstore.Store(folder)
    first = Tokenizer.from_file(PATH).encode(odd[1], add_special_tokens=False).ids
    assert store.get(901).tolist() == [*first, 2] and store.get(12345) is None
    assert got(tokenstore.round_trip(docs, PATH)) == want(hashed)


def test_empty(spark):
    assert tokenstore.round_trip(cases.empty(spark), PATH).count() == 0


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n))
        slots = tokenstore.Hash(tokenstore.build(keys)).slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_lookups_read_a_shard_once_and_misses_are_errors(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i // 2 * 3, cases.prose(30, i)) for i in range(200)] + [(7, "same " * 400)] * 60, "doc_id long, text string")
    folder = str(tmp_path / "store")
    manifest = tokenstore.write(docs, folder, PATH, shard_text=6000)
    assert len(manifest["shards"]) > 10 and max(x["docs"] for x in manifest["shards"]) < 60  # repeated rows are dealt, too
    store, made = tokenstore.Store(folder), []
    real = tokenstore.Shard
    monkeypatch.setattr(tokenstore, "Shard", lambda *a: made.append(1) or real(*a))
    for _ in range(5):
        assert store.get(30) is not None and store.get(31) is None
    assert len(made) <= 2
    assert {r.doc_id for r in docs.collect()} == {i for i in range(400) if store.get(i) is not None}
