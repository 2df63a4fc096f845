import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np

from lexiforge.llm import kneser as k
from tests.llm import cases


def slow_model(texts):
    """Modified Kneser-Ney by its textbook recursion."""
    seqs = [k.START + t for t in texts]
    counts = {k.ORDER: Counter(s[i : i + k.ORDER] for s in seqs for i in range(len(s) - k.ORDER + 1))}
    for n in range(k.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    made = {}
    for n, own in counts.items():
        d = k.discounts([sum(c == i for c in own.values()) for i in (1, 2, 3, 4)])
        total, freed = Counter(), defaultdict(float)
        for g, c in own.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        made[n] = own, d, total, freed

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        own, d, total, freed = made[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        c = own.get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


TRAIN = [cases.prose(60, 1), "Ab, cd. Ab? 12\nxy", "", "aaaa aaab aabb", cases.prose(30, 7).upper(), "один два три 一二三"]


def test_model_is_modified_kneser_ney(spark, monkeypatch):
    """Both ways to score, against the recursion, in pieces of any size."""
    df = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    parts, floor = k.probabilities(k.gram_counts(df))
    model, p = k.Model(parts, floor), slow_model(TRAIN)
    texts = [*TRAIN, None, "x", "zebra 9!", "два 三", cases.prose(300, 4), "aaaa aaab aabb"]
    want = [-sum(math.log(p((k.START + t)[i : i + k.ORDER])) for i in range(len(t))) for t in (t or "" for t in texts)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    for piece in (1 << 20, 100, 7):
        monkeypatch.setattr(k, "PIECE", piece)
        got = np.zeros(len(texts))
        for points, ends, whose in k.pieces(texts):
            got -= np.bincount(whose, model.logs(points, ends), minlength=len(texts))
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    for made in (k.scores(docs, model), k.joined_scores(docs, parts, floor)):
        rows = sorted(made.collect())
        assert [r.n for r in rows] == [len(t or "") for t in texts]
        assert np.allclose([r.nll for r in rows], want, rtol=1e-4, atol=1e-3)
    # all symbols' probabilities after a context add up to one, the unseen symbol's included
    symbols = sorted({c for t in TRAIN for c in k.START + t})
    for context in ("Ab, ", "\n\n\n\n", "aaaa", "qqqq"):
        assert math.isclose(sum(p(context + c) for c in [*symbols, "\u2603"]), 1, rel_tol=1e-6)


def test_clean_stays_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = k.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_odd_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    rows = k.classify(docs, labels).collect()
    assert len(rows) == len(cases.ROWS) and {r.kept for r in rows if r.n_chars == 0} == {False}
    assert k.classify(docs, labels.limit(0)).where("kept").count() == sum(bool(r[1]) for r in cases.ROWS)
    assert k.classify(cases.empty(spark), labels).count() == 0


def test_kept_against_a_plain_computation(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet")
    rows, trusted = docs.collect(), {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    cal = {i for i in trusted if zlib.crc32(str(i).encode()) % 5 == 0}
    p = cache(slow_model([r.text or "" for r in rows if r.doc_id in trusted - cal]))
    nll = {r.doc_id: -sum(math.log(p((k.START + (r.text or ""))[i : i + k.ORDER])) for i in range(len(r.text or ""))) for r in rows}
    mine = [r for r in rows if r.doc_id in cal and r.text]
    near = {lang: sum(nll[r.doc_id] for r in mine if r.lang == lang) / sum(len(r.text) for r in mine if r.lang == lang) for lang in {r.lang for r in mine}}
    whole = sum(nll[r.doc_id] for r in mine) / sum(len(r.text) for r in mine)

    def drawn(r):
        return (nll[r.doc_id] + k.PRIOR * near.get(r.lang, whole)) / (len(r.text) + k.PRIOR)

    def bound(own):
        steps = sorted(math.ceil(drawn(r) * k.STEPS) for r in own)
        return steps[math.ceil(k.QUANTILE * len(steps)) - 1] / k.STEPS

    got = {r.doc_id: r for r in k.classify(docs, labels).collect()}
    for r in rows:
        if not r.text:
            assert not got[r.doc_id].kept
            continue
        limit = bound([x for x in mine if x.lang == r.lang] if r.lang in near else mine)
        assert math.isclose(got[r.doc_id].perplexity, math.exp(drawn(r)), rel_tol=1e-4)
        if abs(drawn(r) - limit) > 2 / k.STEPS:
            assert got[r.doc_id].kept == (drawn(r) < limit)


def test_tables_that_stay_sharded_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet")
    sent = sorted((r.doc_id, r.kept, round(r.perplexity, 2)) for r in k.classify(docs, labels).collect())
    monkeypatch.setattr(k, "SENT_ROWS", 0)
    assert sorted((r.doc_id, r.kept, round(r.perplexity, 2)) for r in k.classify(docs, labels).collect()) == sent


def test_quantile_of_steps(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(["a", "b"])), int(x)) for x in rng.integers(20000, 30000, 3000)] + [(None, 12345)]
    steps = spark.createDataFrame(rows, "lang string, step long").selectExpr("lang", "step", "1L AS c")
    for share in (0.5, 0.995, 1.0):
        got = {r.lang: r.bound for r in k._quantile(steps, ["lang"], share).collect()}
        for lang in ("a", "b", None):
            own = sorted(s for x, s in rows if x == lang)
            assert math.isclose(got[lang], math.exp(own[max(0, math.ceil(share * len(own)) - 1)] / k.STEPS))
    whole = sorted(s for _, s in rows)
    assert math.isclose(k._quantile(steps, [], 0.995).first()[0], math.exp(whole[math.ceil(0.995 * len(whole)) - 1] / k.STEPS))
    assert k._quantile(steps.limit(0), [], 0.995).first() is None


def test_shuffled_ids_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet")
    sent = sorted(map(tuple, k.classify(docs, labels).select("doc_id", "kept").collect()))
    monkeypatch.setattr(k, "SENT_IDS", 0)
    assert sorted(map(tuple, k.classify(docs, labels).select("doc_id", "kept").collect())) == sent
