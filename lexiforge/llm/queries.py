"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import decontam, divergence, kneser, langid, licenses, mixing, packing, rules, secretscan, sharding, simhash, tokenstore, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(_read(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(_read(spark, sf_dir, "documents"), _tokenizer())


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(_read(spark, sf_dir, "documents"))


#: Bytes of a shard of op6_shards: small tables, too, have many.
QUERY_SHARD = 1 << 18


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_SHARD)
    return out.selectExpr("doc_id", "cast(octet_length(coalesce(text, '')) as bigint) AS doc_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def op7_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.findings(_read(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_of(packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_licenses, op2_tokens, op3_mix, op4_language, op5_simhash, op6_shards, op7_kneser, op8_decontam, op9_secrets, op10_rules, op11_whitening, op12_divergence, op13_packing, pipeline]
    return {f.__name__: f for f in own}


_SHARDS = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS b, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents
), l AS (
  SELECT k AS depth, h >> (60 - k) AS p, sum(b) AS shard_bytes, count(*) AS shard_docs
  FROM d, (SELECT unnest(range(0, 61)) AS k) GROUP BY 1, 2
), f AS (SELECT * FROM l WHERE shard_bytes <= {QUERY_SHARD} OR shard_docs = 1 OR depth = 60),
m AS (
  SELECT doc_id, b, h, min(depth) AS depth FROM d JOIN f ON f.p = (d.h >> (60 - f.depth)) GROUP BY 1, 2, 3
)
SELECT m.doc_id, CAST(m.b AS BIGINT) AS doc_bytes,
       CASE WHEN m.depth = 0 THEN '' ELSE substr(lpad(bin(m.h), 60, '0'), 1, m.depth) END AS shard,
       CAST(m.depth AS INTEGER) AS depth, CAST(f.shard_bytes AS BIGINT) AS shard_bytes, CAST(f.shard_docs AS BIGINT) AS shard_docs
FROM m JOIN f ON f.depth = m.depth AND f.p = (m.h >> (60 - m.depth))
"""


_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY 1),
g AS (
  SELECT lang, source, coalesce(max(s), 0) AS n, coalesce(max(v), 0) AS v, coalesce(max(n_lang), 0) AS n_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY 1, 2) USING (lang, source)
  LEFT JOIN l USING (lang) GROUP BY 1, 2
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 2)) // (g.n_lang + 2 * g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_shards": _SHARDS, "op12_divergence": _DIVERGENCE}
