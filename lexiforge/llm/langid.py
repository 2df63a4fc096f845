"""Language identification by hyperdimensional profiles.

Each letter, whatever its script, has a random vector of +1 and -1, made from its code point. The vector of a trigram binds its letters: the product of their
vectors, permuted (rotated) by their place. A text's vector bundles, that is sums, the vectors of its trigrams
(letters lower-cased, anything else a boundary); a language's prototype bundles the texts it is learned from,
each at length one. A text has the language whose prototype has the greatest cosine with it (ties: the first
by name).

Prototypes are learned from at most about `FIT_DOCS` texts of each language, chosen by the hash of doc_id
(a documented bound); every text is predicted. A text that is null or has no letter is `und` with score 0, and
so is every text if nothing can be learned. Null ids are never learned from nor held out; repeated rows are
predicted each. Extra columns are ignored. An empty table gives an empty table. Texts are read in pieces, so a
very long one takes no more memory than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
FIT_DOCS = 2000
SEED = 3
PIECE = 1 << 20
#: Texts whose vectors are made in one matrix product.
TOGETHER = 128
#: Tasks that learn: the texts that are learned from are dealt to them.
LEARNERS = 16
#: Letters whose vectors a worker remembers.
MEMO = 1 << 15


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(MEMO)
def letter_vector(c: int) -> np.ndarray:
    """The vector of a code point; 0 is the boundary."""
    return np.random.default_rng([SEED, c]).choice(np.array([-1, 1], np.int8), DIM)


BITS = 21  # of a code point


def trigram_vectors(ids: np.ndarray) -> np.ndarray:
    mask = (1 << BITS) - 1
    points, place = np.unique(np.concatenate([ids >> 2 * BITS, ids >> BITS & mask, ids & mask]), return_inverse=True)
    own = np.stack([letter_vector(int(c)) for c in points])
    a, b, c = place.reshape(3, -1)
    return (np.roll(own, 2, axis=1)[a] * np.roll(own, 1, axis=1)[b] * own[c]).astype(np.float32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text, as numbers of three code points, and their counts."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = (1 << BITS) - 1
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE]
        s = np.frombuffer(f" {piece.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        s = np.where(letters()[s], s, 0)
        s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
        ids = s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]
        ids = ids[(ids >> BITS & mask) != 0]  # the middle one is a letter
        more = np.unique(ids, return_counts=True)
        if len(total[0]):
            ids, place = np.unique(np.concatenate([total[0], more[0]]), return_inverse=True)
            more = ids, np.bincount(place, np.concatenate([total[1], more[1]])).astype(np.int64)
        total = more
    return total


def vectors(texts: list[str | None]) -> np.ndarray:
    """A row of DIM numbers for each text; zeros for one without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    for at in range(0, len(texts), TOGETHER):
        parts = [trigrams(t or "") for t in texts[at : at + TOGETHER]]
        ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        if not len(ids):
            continue
        counts = np.zeros((len(parts), len(ids)), np.float32)
        counts[np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), place] = np.concatenate([p[1] for p in parts])
        out[at : at + len(parts)] = counts @ trigram_vectors(ids)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """The prototype of each language of docs (doc_id, text, lang), from about fit_docs texts of each."""
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    shares = {r.lang: fit_docs / r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not shares:
        return {}
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("lang")]
    place = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fit = usable.where(place < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, row in zip(langs, _unit(vectors(batch.column(1).to_pylist())), strict=True):
                sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "sum"])

    out: dict[str, np.ndarray] = {}
    # the scan stays parallel, what it finds goes to LEARNERS tasks, and a row a language and task comes here
    for r in fit.repartition(LEARNERS).mapInArrow(run, "lang string, sum binary").collect():
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(r["sum"], np.float64)
    return {k: v for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list) -> DataFrame:
    """keep (columns of docs) with lang_pred and score."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    names = list(prototypes)
    sent = docs.sparkSession.sparkContext.broadcast(_unit(np.array([prototypes[n] for n in names])) if names else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if names:
                rows = _unit(vectors(batch.column(batch.num_columns - 1).to_pylist()).astype(np.float64))
                cosine = rows @ sent.value.T
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(rows.any(axis=1)).tolist():
                    lang[i], score[i] = names[best[i]], min(1.0, max(0.0, cosine[i, best[i]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return source.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose crc32(doc_id) mod 3 is not 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return predict(docs, learn(docs.where(~held)), [F.col("doc_id"), held])
