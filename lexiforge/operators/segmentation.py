"""Sentence boundaries learned from the corpus itself: abbreviations and sentence starters by log-likelihood.

After Kiss and Strunk (2006). A word that nearly always stands before a period, is short and has periods inside is an
abbreviation; a word that follows a period more often than chance allows starts sentences. A period after an
abbreviation ends a sentence only where a starter in upper case follows. Counts are one aggregation of the words of all
texts, partial in each task. The model is all words that reach the least score: a kind of up to MOST words goes to the
tasks as a list, one of more stays a table, with which the ends of pieces are joined. Both ways make the same sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.sources.shared import written

#: Fixed values of the method: the probability of a period after an abbreviation, and the least scores.
PERIOD_AFTER, LEAST_ABBREVIATION, LEAST_STARTER = 0.99, 0.3, 30.0
#: A list in a plan has so many words at most; more are a table.
MOST = 5000

Words = list[str] | DataFrame


@dataclass
class Model:
    """The words of each kind: a list, or a table with the column type."""

    abbreviations: Words
    starters: Words


def _bare(w: Column) -> Column:
    return F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def _type(bare: Column) -> Column:
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def tokens(text: Column) -> Column:
    """The words of a text that have a letter, as they stand there."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """type (in lower case, without its last period), with_period, without: how often each word stands before a period and
    not. Words are counted as they stand first, so that each spelling is taken apart once."""
    spelled = docs.select(F.explode(F.split(F.col(text), r"(?U)\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = spelled.where(F.col("w").rlike(r"\p{L}")).select(_bare(F.col("w")).alias("bare"), "n")
    counts = words.groupBy(_type(F.col("bare")).alias("type")).agg(F.sum(F.when(F.col("bare").endswith("."), F.col("n")).otherwise(0)).alias("with_period"), F.sum("n").alias("n"))
    return counts.select("type", "with_period", (F.col("n") - F.col("with_period")).alias("without"))


def _log(p: Column | float) -> Column:
    return F.log(F.greatest(F.lit(p) if isinstance(p, float) else p, F.lit(1e-300)))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """type, with_period, without, score of the words that stand before a period: how much likelier a fixed high chance of a
    period makes their counts than the chance of all words, times what length, inner periods and uses without a period tell."""
    totals = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("words"))
    k, m = F.col("with_period"), F.col("without")
    chance = F.col("periods") / F.col("words")
    unlike = k * _log(chance) + m * _log(1 - chance)
    like = k * _log(PERIOD_AFTER) + m * _log(1 - PERIOD_AFTER)
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    weight = F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -m.cast("double"))
    rows = counts.where("with_period > 0").crossJoin(F.broadcast(totals))  # one row
    return rows.select("type", k, m, (2 * (like - unlike) * weight).alias("score"))


def starter_scores(docs: DataFrame, abbreviations: Words, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """type, after, n, score of the words that follow a period that ends no abbreviation more often than by chance.
    counts: the texts' `word_counts`, if they are there."""
    counts = word_counts(docs, text) if counts is None else counts
    own = docs.select(tokens(F.col(text)).alias("w"))
    listed = isinstance(abbreviations, list)

    def ends(w: Column) -> Column:
        period = w.contains(".") & _bare(w).endswith(".")
        return period & ~_type(_bare(w)).isin(abbreviations) if listed and abbreviations else period

    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("w", lambda w: F.when(ends(w), F.lit("") if listed else w)))
    words = own.select(F.explode(F.filter(F.arrays_zip(F.col("w").alias("w"), F.slice(before, 1, F.size("w")).alias("before")), lambda x: x["before"].isNotNull())).alias("x"))
    spelled = words.groupBy(F.col("x.w").alias("w"), F.col("x.before").alias("before")).agg(F.count("*").alias("after"))
    if not listed:  # pairs of spellings, counted before they move
        spelled = spelled.withColumn("type", _type(_bare(F.col("before")))).join(abbreviations.select("type"), "type", "left_anti").drop("type")
    followers = written(spelled.groupBy(_type(_bare(F.col("w"))).alias("type")).agg(F.sum("after").alias("after")), "followers")  # read twice
    n = F.col("with_period") + F.col("without")
    totals = followers.agg(F.sum("after").alias("ends")).crossJoin(counts.agg(F.sum(n).alias("words")))  # one row
    rows = followers.join(counts.select("type", n.alias("n")), "type").crossJoin(F.broadcast(totals))

    def likelihood(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * _log(p)).otherwise(0.0) + F.when(n > k, (n - k) * _log(1 - p)).otherwise(0.0)

    after, n, ends_, words_ = (F.col(c) for c in ("after", "n", "ends", "words"))
    chance, inside, outside = n / words_, after / ends_, F.coalesce(F.try_divide(n - after, words_ - ends_), F.lit(0.0))
    score = 2 * (likelihood(after, ends_, inside) + likelihood(n - after, words_ - ends_, outside) - likelihood(after, ends_, chance) - likelihood(n - after, words_ - ends_, chance))
    return rows.select("type", "after", "n", F.when(inside > outside, score).otherwise(0.0).alias("score"))


def _all(scores: DataFrame, least: float) -> Words:
    """All words of the least score or more."""
    rows = written(scores.where(F.col("score") >= least).select("type"), "model")
    found = [r.type for r in rows.limit(MOST + 1).collect()]
    return sorted(found) if len(found) <= MOST else rows


def learn(docs: DataFrame, text: str = "text") -> Model:
    counts = written(word_counts(docs, text), "words")
    abbreviations = _all(abbreviation_scores(counts), LEAST_ABBREVIATION)
    return Model(abbreviations, _all(starter_scores(docs, abbreviations, text, counts), LEAST_STARTER))


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda p: ~t.is_blank(p))


def _ends(pieces: Column, abbreviations: Words) -> Column:
    """place, last, first of the pieces before the last one that end in a period: the word before it and, if it is in upper
    case, the word behind it, both as types. Of abbreviations that are a list, only their ends."""

    def last(p: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_extract(p, r"(?Us)^(?:.*\s)?(\S+)\.$", 1), r"^[^\p{L}\p{N}]+", ""))

    def first(p: Column) -> Column:
        word = F.regexp_extract(p, r"(?U)^[^\p{L}\p{N}\s]*(\S+)", 1)
        return F.when(word.rlike(r"^\p{Lu}"), F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]+$", "")))

    def wanted(e: Column) -> Column:
        known = e["last"].isin(abbreviations) if isinstance(abbreviations, list) else e["last"] != ""
        return (e["place"] < F.size(pieces) - 1) & known

    found = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("place"), last(p).alias("last"))), wanted)
    return F.transform(found, lambda e: F.struct(e["place"], e["last"], first(F.get(pieces, e["place"] + 1)).alias("first")))


def _put(pieces: Column, stay: Column) -> Column:
    """The pieces as sentences: a piece whose place is in stay goes on in the next one, behind a blank."""
    cuts = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), stay)
    before = F.concat(F.array(F.lit(-1)), F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))))
    made = F.zip_with(before, cuts, lambda a, b: F.rtrim(F.array_join(F.slice(pieces, a + 2, b - a), " ")))
    return F.when(F.size(pieces) > 0, made).otherwise(pieces)


def _once(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def _goes_on(first: Column, starters: list[str]) -> Column:
    return ~F.coalesce(first.isin(starters), F.lit(False)) if starters else F.lit(True)


def sentences(text: Column, model: Model) -> Column:
    """The sentences of a text, by a model of lists: it is cut behind . ! and ?, but not behind an abbreviation's period,
    unless a starter in upper case follows. White space at a cut goes; white space where pieces stay together becomes a blank."""
    if model.abbreviations == []:
        return _pieces(text)

    def made(pieces: Column) -> Column:
        stay = F.filter(_ends(pieces, model.abbreviations), lambda e: _goes_on(e["first"], model.starters))
        return _once(F.transform(stay, lambda e: e["place"]), lambda places: _put(pieces, places))

    return _once(_pieces(text), made)


def split(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the column sentences in place of their text, by any model. Where words are a table, the ends of pieces are
    joined with it; texts, in pieces, are written once and meet the places where they go on by a number of their own."""
    listed = [isinstance(words, list) for words in (model.abbreviations, model.starters)]
    if all(listed) or model.abbreviations == []:
        return docs.withColumn("sentences", sentences(F.col(text), model)).drop(text)
    rows = written(docs.withColumns({"_row": F.monotonically_increasing_id(), "_pieces": _pieces(F.col(text))}).drop(text), "pieces")
    ends = rows.select("_row", F.explode(_ends(F.col("_pieces"), model.abbreviations)).alias("e")).select("_row", "e.*")
    if not listed[0]:
        ends = ends.join(model.abbreviations.select(F.col("type").alias("last")), "last", "left_semi")
    if listed[1]:
        ends = ends.where(_goes_on(F.col("first"), model.starters))
    else:  # no type has a blank, and what is in lower case does not meet in one task
        first = F.coalesce("first", F.concat(F.lit(" "), F.col("_row").cast("string")))
        ends = ends.withColumn("first", first).join(model.starters.select(F.col("type").alias("first")), "first", "left_anti")
    # written, so that its size is known: texts move only if it is too large to be sent to them
    stay = written(ends.groupBy("_row").agg(F.collect_list("place").alias("_stay")), "places")
    places = F.coalesce("_stay", F.array().cast("array<int>"))
    return rows.join(stay, "_row", "left").withColumn("sentences", _put(F.col("_pieces"), places)).drop("_row", "_pieces", "_stay")
