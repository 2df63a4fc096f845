from lexiforge.llm import sharding
from tests.llm import cases


def check(docs, limit):
    out = sharding.assign(docs, limit).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(len((r.text or "").encode()))
        assert len(r.shard) == r.depth
    for shard, sizes in by.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        assert {(r.shard_bytes, r.shard_docs) for r in out if r.shard == shard} == {(sum(sizes), len(sizes))}
    prefixes = sorted(by)
    assert not any(b.startswith(a) for a in prefixes for b in prefixes if a != b)
    return by


def test_only_large_buckets_split(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    whole = sum(len((r.text or "").encode()) for r in docs.collect())
    assert list(check(docs, whole)) == [""]
    by = check(docs, 20_000)
    for p in by:  # a bucket and its sibling together are too large, or the sibling has split
        sibling = p[:-1] + "10"[int(p[-1])]
        assert sum(sum(v) for k, v in by.items() if k.startswith(p[:-1])) > 20_000 and sibling is not None


def test_odd_rows_and_repeats(spark):
    docs = cases.frame(spark)
    assert sharding.assign(docs, 100).columns == [c for c in docs.columns if c != "shard"] + ["shard", "depth", "shard_bytes", "shard_docs"]
    check(docs, 100)
    check(cases.frame(spark, [(7, "same text " * 10, "en", "a", 1)] * 50), 1000)
    assert sharding.assign(cases.empty(spark), 100).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    sharding.write_shards(sharding.assign(docs, 50_000), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_sharded_rows_come_from_files(spark, tmp_path):
    docs = cases.frame(spark, [*cases.ROWS, *[(100 + i, cases.prose(50, i), "en", "a", 1) for i in range(40)]]).selectExpr("*", "'x' AS __h", "'y' AS `row`", "'z' AS at")
    got = sharding.sharded(docs, 4000, str(tmp_path / "s"))
    assert got.columns == sharding.assign(docs, 4000).columns
    assert sorted(map(str, got.collect())) == sorted(map(str, sharding.assign(docs, 4000).collect()))
    assert len(list((tmp_path / "s").glob("at_=p*"))) == got.select("shard").distinct().count() > 2
    assert sharding.sharded(cases.empty(spark), 100).count() == 0
