"""The divergence audit, held against Python's integers on every term."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexiforge.llm import divergence
from tests.llm import cases

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def share(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            def ranked(values, part, most=None):
                for rank, (item, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode())), 1):
                    if most is None or rank <= most:
                        out.add((lang, s, part, item, value, rank))

            ranked([(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s], "pair")
            ranked([(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]], "term", top)
    return out


def check(docs, **limits):
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    made = divergence.audit(docs, **limits).select("lang", "source", "part", "item", "value", "rank").collect()
    found = {tuple(r) for r in made}
    assert len(made) == len(found)
    assert found == brute(rows, limits.get("min_docs", 10), limits.get("top", 10))


def test_documents(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    assert docs.count()
    check(docs)


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_odd_rows(spark, min_docs):
    check(cases.frame(spark), min_docs=min_docs)


def test_ties_unicode_and_many_sources(spark):
    words = ["Été", "ÉTÉ", "zz", "ZZ", "a-b", "x\x00y", "\U0001f600", "￮", "日本", "it's"]
    rows = [(i, " ".join(words[j % 10] for j in range(i % 7, i % 7 + 1 + i % 5)), ["en", "en", None][i % 3], f"s{i * 7 % 23}", 0) for i in range(300)]
    docs = cases.frame(spark, rows)
    check(docs, min_docs=3, top=4)
    # blocks of sources and slices of vectors that are smaller than the data
    kept = divergence.kept_terms(docs, 3)
    groups = divergence.group_totals(docs, kept)
    whole = {tuple(r) for r in divergence.pair_values(kept, groups).collect()}
    assert whole == {tuple(r) for r in divergence.pair_values(kept, groups, block=3, slice_=20).collect()}


def test_a_language_without_kept_terms(spark):
    rows = [(1, "alpha", "xx", "a", 0), (2, "beta", "xx", "b", 0), (3, None, "xx", "c", 0), (4, "gamma", "yy", "a", 0)]
    made = divergence.audit(cases.frame(spark, rows)).collect()
    assert {(r.lang, r.source, r.item, r.value, r["rank"]) for r in made} == {
        ("xx", "a", "b", 0, 1), ("xx", "a", "c", 0, 2), ("xx", "b", "a", 0, 1), ("xx", "b", "c", 0, 2), ("xx", "c", "a", 0, 1), ("xx", "c", "b", 0, 2),
    }


def test_counts_beyond_64_bits():
    counts = np.array([[10**12, 3]], np.int64)
    got = divergence.shares(counts, np.array([10**13, 5], np.int64), 7)
    assert got.tolist() == [[1 + 10**9 * (10**12 + 2) // (10**13 + 14), 1 + 10**9 * 5 // 19]]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CUT", 10)
    text = "alpha beta,gamma  deltadeltadeltadelta x ÉÉÉÉÉÉÉÉÉÉ yy"
    assert [t.decode() for part in divergence._terms(text) for t in part] == TERM.findall(text)


def test_empty(spark):
    assert divergence.audit(cases.empty(spark)).count() == 0
