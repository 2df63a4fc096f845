"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) on a text, or abstains (0). A text is good or bad, which isn't seen;
expectation-maximisation over the counts of vote patterns (3 ** len(RULES) at most, whatever the corpus)
estimates the share of good texts and how often each rule votes good, bad or not at all on good and on bad ones,
which are its accuracies. That a rule is silent tells something, too, so a junk that one rule alone knows is
found if good texts hardly ever have that vote. It starts from a belief: a text without a bad vote is likely
good, one with two or more is likely bad. A text stays if the posterior probability of "good" is at least one
half, and if it passes the two base rules.

Rows: a null text has no words, so it fails the base rules; null and repeated ids are kept as they are; an
empty table gives an empty table. `filter_docs` returns the input's columns, `judge` those of its contract.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm._shared import WORD_SPACE, saved

#: (name, bad if, good if); neither: the rule abstains.
RULES = [
    ("word_size", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
    ("symbols", "n_symbols * 10 > n_words", "n_symbols * 100 <= n_words"),
    ("letters", "n_letters * 100 < 85 * word_chars", "n_letters * 100 >= 93 * word_chars"),
    ("bare_words", "n_bare_words * 10 > n_words", "n_bare_words * 50 <= n_words"),
    ("capitals", "n_capitals * 10 > 3 * n_letters", "n_capitals * 10 <= n_letters"),
    ("lines", "n_dup_lines * 10 > 3 * n_lines", "n_dup_lines * 50 <= n_lines"),
    ("repeats", "n_repeat_words * 5 > n_words", "n_repeat_words * 20 <= n_words"),
    ("stops", "n_stops * 50 < n_words AND n_words >= 20", "n_stops * 25 >= n_words"),
]
#: What windows of three words meet by; equal windows must have equal ones.
WINDOW_HASH = "xxhash64(__words[i], __words[i + 1], __words[i + 2])"
ROUNDS = 200


def features(text: Column) -> list[Column]:
    """First-level columns; `measured` builds on them."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        t.alias("__text"),
        F.array_remove(F.split(t, WORD_SPACE, -1), "").alias("__words"),
        lines.alias("__lines"),
    ]


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, and the counts that the rules read.

    Repeated windows: the hash of each 3-word window, shifted to make room for its position, in one sorted
    array of longs. Neighbours of equal hashes may be repeats; these windows' words are sorted and compared, and the
    words that equal windows cover are counted from their positions.
    """
    one = docs.select(F.struct(*keep).alias("__keep"), *features(F.col("text")))
    wordy = r"[^\x20\x09-\x0D\p{L}\p{N}]*+[\p{L}\p{N}][^\x20\x09-\x0D]*+"
    two = one.select(
        "__keep",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.expr(r"length(__text) - length(regexp_replace(__text, '[#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr(r"length(regexp_replace(__text, '[\\x20\\x09-\\x0D]+', ''))").cast("long").alias("word_chars"),
        F.expr(r"length(__text) - length(regexp_replace(__text, '[.!?](?=$|[\\x20\\x09-\\x0D])', ''))").cast("long").alias("n_stops"),
        F.expr(r"length(__text) - length(regexp_replace(__text, '\\p{L}+', ''))").cast("long").alias("n_letters"),
        F.expr(r"length(__text) - length(regexp_replace(__text, '\\p{Lu}+', ''))").cast("long").alias("n_capitals"),
        F.size(F.array_remove(F.split(F.regexp_replace("__text", wordy, ""), WORD_SPACE, -1), "")).cast("long").alias("n_bare_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("length(bin(size(__words)))").alias("__k"),
    )
    packed = F.expr(f"if(n_words < 3, array(), sort_array(transform(sequence(0, int(n_words) - 3), i -> shiftleft({WINDOW_HASH}, __k) | i)))")
    counts = ["n_words", "n_symbols", "word_chars", "n_stops", "n_letters", "n_capitals", "n_bare_words", "n_lines", "n_dup_lines"]
    three = two.select("__keep", *counts, "__k", "__words", packed.cast("array<bigint>").alias("__s"))

    def neighbours(of: str, same: str) -> str:
        before, after = f"{of}[greatest(i - 1, 0)]", f"{of}[least(i + 1, size({of}) - 1)]"
        return f"filter({of}, (x, i) -> (i > 0 AND {same.format(before)}) OR (i + 1 < size({of}) AND {same.format(after)}))"

    near = F.expr(neighbours("__s", "shiftright({}, __k) = shiftright(x, __k)"))
    four = three.select("__keep", *counts, "__words", F.transform(near, lambda x: x.bitwiseAND(F.expr("shiftleft(1L, __k) - 1L")).cast("int")).alias("__near"))
    windows = F.expr("sort_array(transform(__near, p -> struct(concat_ws(' ', __words[p], __words[p + 1], __words[p + 2]) AS w, p AS p)))")
    five = four.select("__keep", *counts, windows.alias("__windows"))
    twice = F.expr(f"sort_array(transform({neighbours('__windows', '{}.w = x.w')}, x -> x.p))")
    six = five.select("__keep", *counts, twice.alias("__at"))
    covered = "aggregate(transform(__at, (p, i) -> if(i = 0, 3L, least(3L, bigint(p - __at[greatest(i - 1, 0)])))), 0L, (a, x) -> a + x)"
    return six.select("__keep.*", *counts, F.expr(covered).alias("n_repeat_words"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def votes() -> Column:
    """A text's votes as one number: digit j in base 3 is 0 for bad, 1 for none, 2 for good of rule j."""
    return F.expr(" + ".join(f"{3**j} * (CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END)" for j, (_, bad, good) in enumerate(RULES)))


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """The probability of "good" for each vote pattern.

    Every rule begins each estimate with ten texts of either kind, on six of which it is right and on one wrong.
    """
    split = {p: [(p // 3**j) % 3 - 1 for j in range(len(RULES))] for p in counts}
    belief = {p: 0.1 if v.count(-1) > 1 or sum(v) < 0 else 0.5 if -1 in v or not sum(v) else 0.9 for p, v in split.items()}
    total = sum(counts.values())
    for _ in range(ROUNDS):
        share = (8 + sum(n * belief[p] for p, n in counts.items())) / (total + 10)
        weight = []  # of each rule's vote: the logarithm of how much likelier it is on good texts than on bad ones
        for j in range(len(RULES)):
            good, bad = {-1: 1.0, 0: 3.0, 1: 6.0}, {-1: 6.0, 0: 3.0, 1: 1.0}
            for p, n in counts.items():
                good[split[p][j]] += n * belief[p]
                bad[split[p][j]] += n * (1 - belief[p])
            of_good, of_bad = sum(good.values()), sum(bad.values())
            weight.append({v: math.log(good[v] / of_good) - math.log(bad[v] / of_bad) for v in good})
        before, belief = belief, {}
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(w[v] for w, v in zip(weight, split[p], strict=True))
            belief[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        if max((abs(belief[p] - before[p]) for p in counts), default=0) < 1e-9:
            break
    return belief


def _judged(rows: DataFrame) -> DataFrame:
    """rows (with __votes, __failed) and __good, the posterior probability."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("__votes").count().collect()}  # 3 ** len(RULES) rows at most
    values = ", ".join(f"({p}, {x!r}D)" for p, x in sorted(posteriors(counts).items())) or "(-1, 0.0D)"
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(__votes, __good)")
    return rows.join(F.broadcast(table), "__votes")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior."""
    got = measured(docs, [F.col("doc_id")])
    rows = saved(got.select("*", votes().alias("__votes"), F.expr(BASE_FAILED).alias("base_failed")), "rules")
    return _judged(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("__good") >= 0.5)).alias("kept"), F.col("__good").alias("posterior"),
    )


def filter_docs(docs: DataFrame) -> DataFrame:
    """The rows of docs that `judge` keeps, with docs' columns."""
    got = measured(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")])
    rows = saved(got.select("__row", votes().alias("__votes"), F.expr(BASE_FAILED).alias("__failed")), "rules")
    return _judged(rows).where("NOT __failed AND __good >= 0.5").select("__row.*")
