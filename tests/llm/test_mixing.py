import re
from collections import defaultdict

from lexiforge.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def want_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(spark, docs, slack):
    rows, got = docs.select("doc_id", "text", "source").collect(), mixing.taken(docs).collect()
    sizes, took, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    want = want_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        took[r.source] += r.taken
    for s in want:
        assert abs(took[s] - want[s]) <= max(slack * want[s], 0.5 * most[s] + 1), (s, took[s], want[s])
    again = {(r.doc_id, r.taken) for r in mixing.taken(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_targets_and_taken(spark):
    check(spark, spark.read.parquet(f"{cases.SF}/documents.parquet"), 0.02)


def test_odd_rows(spark):
    docs = cases.frame(spark)
    check(spark, docs, 0.02)
    assert mixing.taken(cases.empty(spark)).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.taken(docs).collect())
    assert mixing.mixed(cases.empty(spark)).count() == 0


def test_many_equal_rows(spark):
    rows = [(1, "a b c d", "en", "a", 1)] * 60 + [(2, "a b c d", "en", "b", 1)] * 7 + [(9, "e f", "en", None, 1)] * 100
    docs = cases.frame(spark, rows)
    check(spark, docs, 0.05)
    assert mixing.mixed(docs).count() == sum(r.copies for r in mixing.taken(docs).collect())
    check(spark, cases.frame(spark, [(1, "a", "en", "z", 1), (2, "b b b " * 90, "en", "y", 1)]), 0.1)


def test_hot_source_samples_by_chance(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b", 1) for i in range(6000)]
    got = mixing.taken(cases.frame(spark, rows)).collect()
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 5
    short = [r.copies for r in got if r.source == "a" and r.size == 1]
    long_ = [r.copies for r in got if r.source == "a" and r.size == 7]
    assert 0 < sum(short) / len(short) < sum(long_) / len(long_)  # inclusion chances are unequal


def test_numbered_in_blocks(spark):
    """Groups of thousands of equal rows, one of them null, are numbered from 1 without gaps, in order."""
    from lexiforge.llm._shared import numbered

    rows = spark.range(0, 15000, 1, 2).selectExpr("if(id % 3 = 0, NULL, if(id % 3 = 1, 'a', string(id))) AS g", "id % 5 AS o", "'x' AS `a.b`")
    got = defaultdict(list)
    for r in numbered(rows, ["g"], "n", ["o"]).collect():
        got[r.g].append((r.n, r.o))
    assert len(got[None]) == len(got["a"]) == 5000 and len(got) == 5002
    for own in got.values():
        own.sort()
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        assert [o for _, o in own] == sorted(o for _, o in own)
    assert numbered(rows.limit(0), ["g"], "n").count() == 0


def test_columns_named_like_the_operator_s_own(spark):
    docs = cases.frame(spark)
    for c in ("__size", "__times", "__k", "__z", "mix_key", "mix_size", "numbered_block"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {r["__size"] for r in got.collect()} == {"x"}


def test_scale_is_the_one_whose_expected_size_is_the_need(spark):
    rng = __import__("random").Random(3)
    rows = [(s, n, 1 + 0.5 * (n / 50), need) for s, need in (("a", 900.0), ("b", 20.0), (None, 1500.0)) for n in [rng.randrange(0, 50) for _ in range(60)]]
    df = spark.createDataFrame(rows, "source string, size long, tilt double, need double")
    for r in mixing._fitted(df).collect():
        own = [x for x in rows if x[0] == r.source]
        expected = sum(min(1, r.scale * t) * n for _, n, t, _ in own)
        assert abs(expected - min(own[0][3], sum(x[1] for x in own))) < 1e-6
