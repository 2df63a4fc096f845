import re
from collections import Counter

from lexiforge.llm import rules
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6 + i, t, "en", "a", 1) for i, t in enumerate([r[1] for r in cases.ROWS] + ["a b a b a b a b", "x\n \nx\nx ", "q w e\x0bq w e", "a b"])], cases.SCHEMA
    )
    docs = docs.unionByName(extra)
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert {i: tuple(r[c] for c in COUNTS) for i, r in got.items()} == want
    assert not any(r.kept and r.base_failed for r in got.values())


def test_filter_agrees_with_judge_and_keeps_columns(spark):
    docs = cases.frame(spark)
    assert rules.filter_docs(docs).columns == docs.columns
    assert sorted(r.doc_id for r in rules.filter_docs(docs).collect()) == sorted(r.doc_id for r in rules.judge(docs).collect() if r.kept)
    assert rules.judge(cases.empty(spark)).count() == 0 and rules.filter_docs(cases.empty(spark)).count() == 0


def test_em_learns_which_rules_are_right():
    def code(*v):
        return sum((x + 1) * 3**j for j, x in enumerate(v))

    noisy, junk = code(1, 1, 1, 1, 1, 1, 1, -1), code(1, -1, -1, 1, 1, 1, 1, 1)
    counts = {code(*[1] * 8): 900, noisy: 400, junk: 60, code(1, -1, -1, 1, 1, 1, 1, -1): 30}
    belief = rules.posteriors(counts)
    assert belief[noisy] > 0.9  # a rule that often votes bad on texts that all others like
    assert belief[junk] < 0.1  # two rules that confirm each other


def plain_posteriors(votes):
    """The same model, text by text: no counts of patterns."""
    import numpy as np

    votes = np.array(votes)
    bad, total = (votes < 0).sum(axis=1), votes.sum(axis=1)
    belief = np.where((bad > 1) | (total < 0), 0.1, np.where((bad > 0) | (total == 0), 0.5, 0.9))
    for _ in range(200):
        share = (8 + belief.sum()) / (len(votes) + 10)
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            seen = {v: votes[:, j] == v for v in (-1, 0, 1)}
            good = {v: belief[s].sum() + {-1: 1, 0: 3, 1: 6}[v] for v, s in seen.items()}
            poor = {v: (1 - belief[s]).sum() + {-1: 6, 0: 3, 1: 1}[v] for v, s in seen.items()}
            for v, s in seen.items():
                odds[s] += np.log(good[v] / sum(good.values())) - np.log(poor[v] / sum(poor.values()))
        before, belief = belief, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(belief - before).max() < 1e-9:
            break
    return belief


def brute_votes(text):
    import regex

    text = text or ""
    words, n = WORD.findall(text), len(WORD.findall(text))
    chars, letters, capitals = sum(map(len, words)), len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    symbols, dup, repeats = brute(text)[2:5]
    bare = sum(not regex.search(r"[\p{L}\p{N}]", w) for w in words)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    stops = len(re.findall(r"[.!?](?=$|[\x20\x09-\x0D])", text))
    pairs = [
        (chars < 3 * n or chars > 12 * n, 4 * n <= chars <= 9 * n), (symbols * 10 > n, symbols * 100 <= n), (letters * 100 < 85 * chars, letters * 100 >= 93 * chars),
        (bare * 10 > n, bare * 50 <= n), (capitals * 10 > 3 * letters, capitals * 10 <= letters), (dup * 10 > 3 * lines, dup * 50 <= lines),
        (repeats * 5 > n, repeats * 20 <= n), (stops * 50 < n and n >= 20, stops * 25 >= n),
    ]
    return [-1 if bad else int(good) for bad, good in pairs]


def test_kept_against_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").unionByName(cases.frame(spark, [(r[0] and r[0] + 10**6, *r[1:]) for r in cases.ROWS], extra=False))
    rows = sorted(docs.collect(), key=str)
    belief = plain_posteriors([brute_votes(r.text) for r in rows])
    want = Counter((r.doc_id, bool(b >= 0.5 and not brute(r.text)[5])) for r, b in zip(rows, belief, strict=True))
    assert Counter((r.doc_id, r.kept) for r in rules.judge(docs).collect()) == want


def test_clean_stays_and_junk_goes(spark):
    """Of labelled documents that pass the base rules, most bad ones go, and hardly a good one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 200 and sum(bad) <= 0.1 * len(bad)
    assert sum(good) >= 0.97 * len(good)


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    plan = rules.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_windows_of_equal_hashes_are_compared(spark, monkeypatch):
    """With one hash for all windows, only the words tell them apart: the counts stay exact."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "WINDOW_HASH", "1L")
    texts = ["a b c d e f g", "q r s q r s q r s", "x y", "a b c x y z a b c", "a b c d a b c e a b c d"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], cases.SCHEMA)
    got = {r.doc_id: r.n_repeat_words for r in rules.measured(docs, [F.col("doc_id")]).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}
