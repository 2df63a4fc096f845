"""The learned segmentation, on texts with planted abbreviations."""

import math
import random

from pyspark.sql import functions as F

from lexiforge.operators import segmentation as s

ABBREVIATIONS = ["dr", "approx", "z.B", "e.g", "Sgt"]


def planted(n=300, seed=1):
    """Texts and their sentences: abbreviations stand before words that start no sentence."""
    rng = random.Random(seed)
    words = "river stone winter garden letter window market bridge yellow harbour silver morning castle doctor".split()
    starts = ["The", "However", "Yesterday", "Nobody"]
    out = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(2, 6)):
            body = [rng.choice(words) for _ in range(rng.randint(4, 9))]
            if rng.random() < 0.5:
                body.insert(rng.randint(1, len(body) - 1), rng.choice(ABBREVIATIONS) + ".")
            own.append(f"{rng.choice(starts)} {' '.join(body)}" + rng.choice([".", ".", ".", "!", "?"]))
        out.append((i, " ".join(own), own))
    return out


def found(df, column, truth):
    hit = made = true = 0
    for r in df.select("id", column.alias("s")).collect():
        ends, mine = (set(), set())
        for target, parts in ((ends, truth[r.id]), (mine, r.s)):
            at = 0
            for p in parts:
                at += len(p) + 1
                target.add(at)
        hit, made, true = hit + len(ends & mine), made + len(mine), true + len(ends)
    return hit / made, hit / true


def test_planted_abbreviations(spark):
    rows = planted()
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "id long, text string")
    truth = {i: own for i, _, own in rows}
    model = s.learn(df)
    assert {a.lower() for a in ABBREVIATIONS} <= set(model.abbreviations) and {"the", "however", "yesterday", "nobody"} <= set(model.starters)
    plain = found(df, F.split("text", r"(?<=[.!?])\s+"), truth)
    learned = found(df, s.sentences(F.col("text"), model), truth)
    assert learned[0] >= 0.99 and learned[1] >= 0.99 and plain[0] < 0.85


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("Dr. No saw dr. Who. The end. no",), (None,), ("",)], "text string")
    counts = {r.type: (r.with_period, r.without) for r in s.word_counts(df).collect()}
    assert counts == {"dr": (2, 0), "no": (0, 2), "saw": (0, 1), "who": (1, 0), "the": (0, 1), "end": (1, 0)}
    score = {r.type: r.score for r in s.abbreviation_scores(s.word_counts(df)).collect()}
    assert set(score) == {"dr", "who", "end"}
    assert math.isclose(score["dr"], 2 * (2 * math.log(0.99) - 2 * math.log(4 / 8)) * math.exp(-2))


def test_odd_texts(spark):
    model = s.Model(["dr"], ["the"])
    df = spark.createDataFrame([("A dr. No. B",), ("x dr. The y",), ("(dr. a",), ("",), (None,), ("  \n ",), ("dr.",), ("a.  b!\n\nc?",)], "text string")
    got = [r[0] for r in df.select(s.sentences(F.col("text"), model)).collect()]
    assert got == [["A dr. No.", "B"], ["x dr.", "The y"], ["(dr. a"], [], None, [], ["dr."], ["a.", "b!", "c?"]]
    empty = s.learn(df.limit(0))
    assert empty == s.Model([], []) and df.select(s.sentences(F.col("text"), empty)).first()[0] == ["A dr.", "No.", "B"]


def test_a_long_run_costs_in_proportion_to_its_length(spark):
    import time

    df = spark.createDataFrame([("a dr. b " + "x" * 200_000 + "! End.",)], "text string")
    at = time.time()
    got = df.select(s.sentences(F.col("text"), s.Model(["dr"], ["the"]))).first()[0]
    assert got == ["a dr. b " + "x" * 200_000 + "!", "End."] and time.time() - at < 15


def test_no_abbreviation_is_dropped(spark, tmp_path):
    """As many abbreviations of the same score as the list of a plan has words, and some more."""
    import itertools

    from lexiforge.plans import catalogue

    own = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqr", repeat=3), 5100)]
    rows = [(i, f"River {w}. stone winter garden letter {w}. window market bridge yellow {w}. harbour silver morning castle") for i, w in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["learned_sentences"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.place, r.sentence) for r in got) == [(i, 0, x) for i, x in rows]


def test_lists_and_tables_make_the_same_model_and_sentences(spark, monkeypatch):
    odd = ["A dr. No. B", "x dr. The y", "(dr. a", "", None, "  \n ", "dr.", "a.  b!\n\nc?", "a dr.\x01 b dr. (the c.\x01 D", "dr. dr. DR. \u00dcber dr. \"The\" end.  "]
    texts = [x for _, x, _ in planted()] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = s.learn(df)
    monkeypatch.setattr(s, "MOST", 0)
    tables = s.learn(df)
    for words, rows in ((listed.abbreviations, tables.abbreviations), (listed.starters, tables.starters)):
        assert len(words) > 2 and sorted(r.type for r in rows.collect()) == words
    want = {r.id: r.sentences for r in s.split(df, listed).collect()}
    assert set(want) == set(range(len(texts))) and want == {r.id: r.s for r in df.select("id", s.sentences(F.col("text"), listed).alias("s")).collect()}
    for a in (listed.abbreviations, tables.abbreviations):
        for b in (listed.starters, tables.starters, []):
            got = s.split(df, s.Model(a, b))
            assert got.columns == ["id", "sentences"]
            rows = {r.id: r.sentences for r in got.collect()}
            assert rows == (want if b else {r.id: r.sentences for r in s.split(df, s.Model(listed.abbreviations, [])).collect()})
