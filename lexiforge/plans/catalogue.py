"""The queries that the driver runs, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.functions import vector as v
from lexiforge.models import base
from lexiforge.operators import catalog, chunking, markdown, profile
from lexiforge.operators import retrieval as r
from lexiforge.sources import scan
from lexiforge.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as stored chunks: the text, language and source of the document with the same number."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = e.join(d, e["vec_id"] == d["doc_id"])
    return joined.select(F.col("vec_id").alias("id"), "embedding", F.col("text").alias("document"), F.concat_ws("/", "source", "lang").alias("path"), F.concat(F.lit("label_"), "label", F.lit(","), "lang").alias("tags"))


WORDS, PREFERRED = ["label_2", "fr"], ["src1*/*"]

# --- vectors ----------------------------------------------------------------------------------------------

_Q = "SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0"
_COSINE = "1 - list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q)))"
_L2 = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_IP = "1 - list_inner_product(CAST(embedding AS DOUBLE[]), q)"


def _top(metric: str, spec: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return r.top_k(e, query_vector(spark, sf_dir), 40, metric, spec, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))

    return run


for _name, _metric, _sql in (("vector_topk_cosine", "cosine", _COSINE), ("vector_topk_l2", "l2", _L2), ("vector_topk_ip", "ip", _IP)):
    QUERIES[_name] = _top(_metric)
    SQL[_name] = f"SELECT vec_id, round({_sql}, 6) + 0.0 AS distance FROM embeddings, ({_Q}) ORDER BY {_sql}, vec_id LIMIT 40"
QUERIES["vector_topk_filtered"] = _top("cosine", {"$and": [{"label": {"$in": [1, 2, 3, 4]}}, {"label": {"$gt": 1}}]})
SQL["vector_topk_filtered"] = f"SELECT vec_id, round({_COSINE}, 6) + 0.0 AS distance FROM embeddings, ({_Q}) WHERE label IN (1, 2, 3, 4) AND label > 1 ORDER BY {_COSINE}, vec_id LIMIT 40"


@query(f"""
SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank FROM (
  SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
    SELECT query_id, vec_id, {_COSINE} AS d FROM embeddings, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0)))
WHERE rank <= 10""")
def vector_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = r.top_k_batch(e, asked, 10, key="vec_id")
    return got.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def vector_index_topk(spark, sf_dir):
    from lexiforge.operators.vector_index import VectorIndex
    from lexiforge.sources.shared import new_path

    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex.build(e, new_path(spark, "index"), key="vec_id")
    return index.search(asked, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


# --- retrieval --------------------------------------------------------------------------------------------

_CHUNKS = "chunks AS (SELECT vec_id AS id, embedding, text AS document, source || '/' || lang AS path, 'label_' || label || ',' || lang AS tags FROM embeddings JOIN documents ON vec_id = doc_id)"
_HITS = f"hits AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT *, {_COSINE} AS distance FROM chunks, ({_Q})) ORDER BY distance, id LIMIT 40)"
_SOURCES = "sources AS (SELECT *, greatest(0.0, least(1.0, 1 - distance)) AS sim0, substr(document, 1, 200) AS context FROM hits)"
_TAGGED = "list_has_any(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), ['fr', 'label_2'])"
_SCORED = f"scored AS (SELECT *, (CASE WHEN {_TAGGED} THEN 1.5 ELSE 1.0 END) * (CASE WHEN regexp_matches(path, '^src1.*/') THEN 1.1 ELSE 1.0 END) AS boost FROM sources), scored2 AS (SELECT *, CAST(sim0 * boost AS DOUBLE) AS similarity FROM scored)"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, rank) AS rn FROM scored2) WHERE rn = 1)"
_KEPT = f"kept AS (SELECT *, similarity >= 0.2 AS direct FROM best WHERE similarity >= 0.2 OR ({_TAGGED} AND similarity >= 0.1)), placed AS (SELECT *, row_number() OVER (ORDER BY direct DESC, similarity DESC, rank) AS place FROM kept)"
_BUDGET = r"counted AS (SELECT *, len(list_filter(string_split_regex(document, '\s+'), lambda x: x <> '')) AS n_words FROM placed), budgeted AS (SELECT * FROM (SELECT *, sum(n_words) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS used_words FROM counted) WHERE used_words <= 4096)"
_WITH = "WITH " + ", ".join([_CHUNKS, _HITS, _SOURCES, _SCORED, _BEST, _KEPT, _BUDGET])


def _sources(spark, sf_dir):
    return r.as_sources(r.top_k(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir)), F.col("path"))


def _scored(spark, sf_dir):
    return r.hybrid_score(_sources(spark, sf_dir), WORDS, PREFERRED, 1.5, 1.1)


def _kept(spark, sf_dir):
    return r.filtered(r.best_of_document(_scored(spark, sf_dir)), WORDS)


@query(f"{_WITH} SELECT id, path AS source_document, round(sim0, 6) AS similarity, round(1 - distance, 6) AS original_similarity, context, rank FROM sources")
def source_build(spark, sf_dir):
    return _sources(spark, sf_dir).select("id", "source_document", F.round("similarity", 6).alias("similarity"), F.round("original_similarity", 6).alias("original_similarity"), "context", F.col("rank").cast("long").alias("rank"))


@query(f"{_WITH} SELECT id, round(CAST(boost AS DOUBLE), 6) AS boost, round(similarity, 6) AS similarity FROM scored2")
def hybrid_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.round("boost", 6).alias("boost"), F.round("similarity", 6).alias("similarity"))


@query(f"{_WITH} SELECT id, path AS source_document, round(similarity, 6) AS similarity FROM best")
def dedup_sources(spark, sf_dir):
    return r.best_of_document(_scored(spark, sf_dir)).select("id", "source_document", F.round("similarity", 6).alias("similarity"))


@query(f"{_WITH} SELECT id, direct, place FROM placed")
def filter_sources(spark, sf_dir):
    return _kept(spark, sf_dir).select("id", "direct", F.col("place").cast("long").alias("place"))


@query(f"{_WITH} SELECT id, place, CAST(n_words AS BIGINT) AS n_words, CAST(used_words AS BIGINT) AS used_words FROM budgeted")
def context_budget(spark, sf_dir):
    return r.within_budget(_kept(spark, sf_dir)).select("id", F.col("place").cast("long").alias("place"), F.col("n_words").cast("long").alias("n_words"), "used_words")


@query(f"{_WITH} SELECT coalesce(string_agg(chr(10) || '---' || chr(10) || document, '' ORDER BY place), '') AS context, count(*) AS n_sources FROM budgeted")
def context_text(spark, sf_dir):
    return r.context_text(r.within_budget(_kept(spark, sf_dir)))


@query(f"{_WITH} SELECT place, id, path AS source_document, round(similarity, 6) AS similarity, round(1 - distance, 6) AS original_similarity, context FROM budgeted")
def rag_pipeline(spark, sf_dir):
    from lexiforge.plans.rag import Settings, plan

    s = Settings(preferred=PREFERRED, source_boost=1.1)
    got = plan(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir), WORDS, s, document=F.col("path"))
    return got.select(F.col("place").cast("long").alias("place"), "id", "source_document", F.round("similarity", 6).alias("similarity"), F.round("original_similarity", 6).alias("original_similarity"), "context")


@query("SELECT vec_id, round(CASE WHEN s = 0 THEN 0.0 ELSE list_inner_product(CAST(embedding AS DOUBLE[]), z) / s END, 6) AS cosine FROM (SELECT vec_id, embedding, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE abs(x) END) AS z, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(z, z)) AS s FROM embeddings)")
def cosine_zero_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("z", F.expr("transform(embedding, x -> if(vec_id % 7 = 0, 0D, abs(cast(x AS double))))"))
    return e.select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("z")), 6).alias("cosine"))


# --- catalogue --------------------------------------------------------------------------------------------

_DOCS = "docs AS (SELECT *, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '' END AS path, sha256(text) AS checksum FROM documents)"


def docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    suffix = F.expr("CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '' END")
    return d.withColumn("path", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), suffix)).withColumn("checksum", F.sha2(F.col("text").cast("binary"), 256))


@query(f"WITH {_DOCS} SELECT doc_id, path FROM docs WHERE regexp_matches(path, '^src1.*/[de].*[.]md$')")
def list_glob(spark, sf_dir):
    return catalog.by_glob(docs(spark, sf_dir), "src1*/[de]*.md").select("doc_id", "path")


@query(f"WITH {_DOCS} SELECT doc_id, path FROM docs WHERE starts_with(path, 'src1/')")
def list_prefix(spark, sf_dir):
    return catalog.by_glob(docs(spark, sf_dir), "src1/*").select("doc_id", "path")


@query(f"WITH {_DOCS}, p AS (SELECT source || '/' || lang AS path, checksum, min(doc_id) AS doc_id FROM docs GROUP BY 1, 2) SELECT * FROM p")
def list_unique(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang"))
    return catalog.unique_documents(d.select("path", "checksum", "doc_id"), "doc_id")


@query(f"WITH {_DOCS} SELECT count(*) AS n_documents FROM (SELECT DISTINCT source || '/' || lang, checksum FROM docs)")
def doc_count(spark, sf_dir):
    return catalog.document_count(docs(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang")))


@query(f"WITH {_DOCS} SELECT list_last(string_split(path, '.')) AS file_type, count(*) AS n FROM docs GROUP BY 1")
def type_stats(spark, sf_dir):
    return catalog.type_counts(docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT CASE WHEN doc_id % 5 = 0 THEN lang WHEN doc_id % 3 = 0 THEN 'md' WHEN doc_id % 3 = 1 THEN 'txt' ELSE '-' END AS file_type, count(*) AS n FROM docs GROUP BY 1")
def type_stats_shown(spark, sf_dir):
    return catalog.type_counts_shown(docs(spark, sf_dir).withColumn("file_type", F.expr("if(doc_id % 5 = 0, lang, '')")))


@query("SELECT count(*) AS n_with_metadata FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 1")
def docs_with_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("if(doc_id % 5 = 0, lang, '-') AS file_type", "if(doc_id % 7 = 1, n_chars, NULL) AS chunk_count", "'' AS last_modified")
    return catalog.with_metadata(d)


@query("SELECT DISTINCT lower(trim(tag)) AS tag FROM (SELECT unnest(string_split('Label_' || label || ', ,x' || (vec_id % 3), ',')) AS tag FROM embeddings) WHERE trim(tag) <> ''")
def distinct_tags(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return catalog.distinct_tags(e.select(F.concat(F.lit("Label_"), "label", F.lit(", ,x"), F.expr("vec_id % 3")).alias("tags")))


@query("SELECT source || ':' || n_chars AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return catalog.duplicate_ids(table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "n_chars").alias("id")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(lower(source), 'src1') OR lower(lang) = 'fr' OR contains(lower(coalesce('q' || quality, '')), 'src1')")
def metadata_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("tags"), F.concat(F.upper("lang"), F.lit(", other")), F.lit("source"), F.upper("source"), F.lit("q"), F.concat(F.lit("q"), "quality")).alias("metadata"))
    return catalog.metadata_search(rows, " SRC1 ").union(catalog.metadata_search(rows, "Fr")).distinct()


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND doc_id % 4 = 0) OR doc_id % 10 = 3")
def incomplete_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.selectExpr("doc_id", "if(doc_id % 10 = 3, 'a/b.PNG', 'a/b.md') AS path", "quality = 0 AS skipped", "if(toxic = 1, 'toxic', NULL) AS skip_reason", "if(quality IS NOT NULL AND doc_id % 4 = 0, 0, NULL) AS chunk_count")
    return catalog.incomplete(rows).select("doc_id")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE checksum NOT IN (SELECT checksum FROM docs JOIN labels USING (doc_id)) OR checksum IN (SELECT checksum FROM docs WHERE doc_id % 50 = 0)")
def needs_processing(spark, sf_dir):
    d = docs(spark, sf_dir).select("checksum", "doc_id")
    stored = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return catalog.needs_processing(d, stored, d.where("doc_id % 50 = 0")).select("doc_id")


@query("SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_PATTERNS = "p AS (SELECT * FROM (VALUES ('src1*/en/*', '^src1.*/en/'), ('*.md', '[.]md$'), ('nothing*', '^nothing')) AS t(pattern, regex))"


@query(f"WITH {_DOCS}, {_PATTERNS} SELECT path, pattern FROM docs, p WHERE regexp_matches(path, regex)")
def remove_match(spark, sf_dir):
    return catalog.removal_matches(docs(spark, sf_dir), ["src1*/en/*", "*.md", "nothing*"])


@query(f"WITH {_DOCS}, {_PATTERNS}, m AS (SELECT pattern, path, doc_id FROM p LEFT JOIN docs ON regexp_matches(path, regex)) SELECT pattern, path, CASE WHEN path IS NULL THEN 'not_found' WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'removed' END AS status FROM m")
def remove_verify(spark, sf_dir):
    d = docs(spark, sf_dir)
    return catalog.removal_report(d, d.where("doc_id % 2 = 0"), ["src1*/en/*", "*.md", "nothing*"])


@query(f"""WITH {_DOCS}, p AS (
  SELECT DISTINCT unnest([source || '/' || lang || '/' || left(doc_id::VARCHAR, 2) || '*', '*/' || (doc_id % 100) || '.md', '*' || lang || '/1' || (doc_id % 10) || '?.t*',
                          source || '/' || lang || '/' || doc_id || '.txt', '*?/[d-e]?/' || (doc_id % 7) || '[!0-4]*']) AS pattern FROM documents)
SELECT path, pattern FROM docs, p WHERE path GLOB pattern AND path IS NOT NULL GROUP BY 1, 2""")
def pattern_matches(spark, sf_dir):
    patterns = table(spark, sf_dir, "documents").select(F.explode(F.array(
        F.expr("source || '/' || lang || '/' || left(cast(doc_id AS string), 2) || '*'"), F.expr("'*/' || (doc_id % 100) || '.md'"), F.expr("'*' || lang || '/1' || (doc_id % 10) || '?.t*'"),
        F.expr("source || '/' || lang || '/' || doc_id || '.txt'"), F.expr("'*?/[d-e]?/' || (doc_id % 7) || '[!0-4]*'"),
    )).alias("pattern"))
    return catalog.removal_matches(docs(spark, sf_dir), patterns)


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars BETWEEN 500 AND 5000 GROUP BY 1")
def facet_counts(spark, sf_dir):
    from lexiforge.functions.predicates import where

    return catalog.facet(table(spark, sf_dir, "documents").where(where({"n_chars": {"$gte": 500, "$lte": 5000}})), "source")


# --- chunks -----------------------------------------------------------------------------------------------

_SENTENCES = r"list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_TAIL = "list_reduce(list_prepend({'k': CAST([] AS VARCHAR[]), 'n': 0, 's': ''}, list_transform(list_reverse(%s), lambda s: {'k': CAST([] AS VARCHAR[]), 'n': 0, 's': s})), lambda a, x: CASE WHEN a.n >= 128 THEN a ELSE {'k': list_prepend(x.s, a.k), 'n': a.n + length(x.s), 's': ''} END).k"
_CHUNK_SQL = rf"""
d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM documents),
s AS (SELECT doc_id, text, {_SENTENCES} AS ss FROM d),
f AS (SELECT doc_id, text, list_reduce(list_prepend({{'out': CAST([] AS VARCHAR[]), 'cur': CAST([] AS VARCHAR[]), 'n': 0, 's': ''}},
        list_transform(ss, lambda s: {{'out': CAST([] AS VARCHAR[]), 'cur': CAST([] AS VARCHAR[]), 'n': 0, 's': s}})),
      lambda a, x: CASE WHEN a.n + length(x.s) > 2048 AND len(a.cur) > 0 THEN
          {{'out': list_append(a.out, array_to_string(a.cur, ' ')),
            'cur': list_append(CASE WHEN len(a.cur) > 1 THEN {_TAIL % 'a.cur'} ELSE CAST([] AS VARCHAR[]) END, x.s),
            'n': CAST(coalesce(CASE WHEN len(a.cur) > 1 THEN list_sum(list_transform({_TAIL % 'a.cur'}, lambda z: length(z))) ELSE 0 END, 0) + length(x.s) AS INTEGER), 's': ''}}
        ELSE {{'out': a.out, 'cur': list_append(a.cur, x.s), 'n': CAST(a.n + length(x.s) AS INTEGER), 's': ''}} END) AS a FROM s),
g AS (SELECT doc_id, CASE WHEN length(text) <= 512 THEN [text] ELSE CASE WHEN len(a.cur) > 0 THEN list_append(a.out, array_to_string(a.cur, ' ')) ELSE a.out END END AS made, text FROM f),
h AS (SELECT doc_id, list_filter(made, lambda c: length(c) >= 512 OR len(made) = 1) AS chunks FROM g),
c AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS chunk_index FROM h)
"""


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.sentence_chunks(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk"))


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk FROM c")
def chunk_sentences(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(coalesce(sum(length(chunk)) OVER w, 0) AS BIGINT) AS start_offset, CAST(coalesce(sum(length(chunk)) OVER w, 0) + length(chunk) - 1 AS BIGINT) AS end_offset FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def chunk_positions(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", chunking.sentence_chunks(F.col("text")).alias("chunks"))
    return chunking.positions(made, "doc_id").select("doc_id", "chunk_index", "start_offset", "end_offset")


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(chunk)) AS BIGINT) AS total_tokens FROM c GROUP BY 1")
def doc_totals(spark, sf_dir):
    return chunking.totals(_chunks(spark, sf_dir), "doc_id")


_WORDS_SQL = r"""
t AS (SELECT unnest(list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$', '', 'g')), lambda w: regexp_matches(w, '\p{L}'))) AS w FROM documents),
c AS (SELECT lower(regexp_replace(w, '[.]$', '')) AS type, count(*) FILTER (w LIKE '%.') AS with_period, count(*) FILTER (w NOT LIKE '%.') AS without FROM t GROUP BY 1),
n AS (SELECT sum(with_period) / sum(with_period + without) AS p FROM c),
l AS (SELECT *, length(replace(type, '.', '')) AS letters, length(type) AS len FROM c, n WHERE with_period > 0)
"""


@query(f"WITH {_WORDS_SQL} SELECT type, with_period, without, round(2 * (with_period * (ln(0.99::DOUBLE) - ln(p)) + without * (ln(1 - 0.99::DOUBLE) - ln(1 - p))) * exp(-letters) * (len - letters + 1) * pow(letters::DOUBLE, -without::DOUBLE), 6) + 0.0 AS score FROM l")
def abbreviation_scores(spark, sf_dir):
    from lexiforge.operators import segmentation

    scores = segmentation.abbreviation_scores(segmentation.word_counts(table(spark, sf_dir, "documents")))
    return scores.select("type", "with_period", "without", (F.round("score", 6) + 0.0).alias("score"))


@query()
def learned_sentences(spark, sf_dir):
    from lexiforge.operators import segmentation

    d = table(spark, sf_dir, "documents")
    made = segmentation.split(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), segmentation.learn(d))
    return made.select("doc_id", F.posexplode("sentences").alias("place", "sentence"))


_SUM_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@query(
    "SELECT doc_id, regexp_replace(CASE WHEN len("
    + _SUM_WORDS.format("string_split(text, '. ')[1]")
    + ") < 5 THEN array_to_string(list_slice("
    + _SUM_WORDS.format("text")
    + r", 1, 20), ' ') ELSE string_split(text, '. ')[1] END, '^\s+|\s+$', '', 'g') AS summary FROM documents"
)
def chunk_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.summary(F.col("text")).alias("summary"))


_URL = r"""(https?://[^\s)''"<>]+|ftp://[^\s)''"<>]+)"""


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html || ' ' || url, '{_URL}', 1))), ',') AS urls FROM pages")
def url_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", t.url_cell(t.url_contexts(F.concat_ws(" ", "html", "url"), "paragraph")).alias("urls"))


_RAW = r"""(https?://[^\s)\]"''<>]+|ftp://[^\s)\]"''<>]+)"""


@query(f"SELECT page_id, 1 + len(regexp_extract_all('[x](' || url || ') ' || replace(html, '[', '('), '{_RAW}', 1)) AS n_contexts, url AS first_url FROM pages")
def link_contexts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("[x]("), "url", F.lit(") "), F.regexp_replace("html", r"\[", "(")).alias("text"))
    found = t.url_contexts(F.col("text"), "markdown")
    return p.select("page_id", F.size(found).cast("long").alias("n_contexts"), found[0]["url"].alias("first_url"))


_MD = "m AS (SELECT doc_id, '## ' || replace(coalesce(text, ''), chr(10), chr(10) || '# ') AS text FROM documents)"


def _md(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# "))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## "), text).alias("text"))


@query(rf"WITH {_MD}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM m) SELECT doc_id, line_no AS line, CASE WHEN line_no = 0 THEN 2 ELSE 1 END AS level, regexp_replace(regexp_extract(line, '^#+\s+(.*)$', 1), '^\s+|\s+$', '', 'g') AS header FROM l")
def header_lines(spark, sf_dir):
    found = _md(spark, sf_dir).select("doc_id", F.explode(markdown.headers(t.lines(F.col("text")))).alias("h"))
    return found.select("doc_id", F.col("h.line").cast("long").alias("line"), "h.level", F.col("h.text").alias("header"))


_PAGE_MD = "pm AS (SELECT page_id, 'intro' || chr(10) || '# ' || url || chr(10) || chr(10) || 'First part.' || chr(10) || '## ' || (page_id % 7) || chr(10) || 'Second #tag' || (page_id % 3) || ' [l](' || url || ').' || chr(10) AS text FROM pages)"


@query(f"WITH {_PAGE_MD} SELECT page_id, CAST(unnest([0, 1]) AS INTEGER) AS chunk_index, unnest([url, CAST(page_id % 7 AS VARCHAR)]) AS section_header, unnest(['# ' || url || chr(10) || chr(10) || 'First part.', '## ' || (page_id % 7) || chr(10) || 'Second #tag' || (page_id % 3) || ' [l](' || url || ').']) AS text, unnest(['', 'tag' || (page_id % 3)]) AS tags, unnest([url, url || ' > ' || (page_id % 7)]) AS path FROM pages")
def section_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.expr("concat('intro\\n# ', url, '\\n\\nFirst part.\\n## ', page_id % 7, '\\nSecond #tag', page_id % 3, ' [l](', url, ').\\n')")
    got = markdown.chunks(p.select("page_id", text.alias("text")), "page_id")
    return got.select("page_id", "chunk_index", "section_header", "text", F.when(F.col("chunk_index") == 1, F.col("tags")).otherwise("").alias("tags"), F.array_join("section_hierarchy", " > ").alias("path"))


_OUTLINE = "concat('# ', source, '\\n', text, '\\n## ', lang, '\\n', text, '\\n# end')"


@query("""WITH d AS (SELECT doc_id, source, lang, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, 0 AS line, source AS path FROM d UNION ALL SELECT doc_id, CAST(n + 1 AS INTEGER), source || ' > ' || lang FROM d UNION ALL SELECT doc_id, CAST(2 * n + 2 AS INTEGER), source || ' > ' || lang || ' > end' FROM d""")
def header_path(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", t.lines(F.expr(_OUTLINE)).alias("lines")).withColumn("heads", markdown.headers(F.col("lines")))
    found = own.select("doc_id", F.explode(markdown.sections(F.col("lines"), F.col("heads"))).alias("s"))
    return found.select("doc_id", F.col("s.start_offset").cast("int").alias("line"), F.array_join("s.section_hierarchy", " > ").alias("path"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all('x#no #tag' || (doc_id % 3) || ' ##no ' || coalesce(text, '') || ' (#a-b), #tag' || (doc_id % 3) || ' # no', '(?:^|[^#\\w\\x{80}-\\x{10FFFF}])#([A-Za-z0-9_-]+)', 1))), ',') AS tags FROM documents")
def hashtag_list(spark, sf_dir):
    text = F.expr("concat('x#no #tag', doc_id % 3, ' ##no ', coalesce(text, ''), ' (#a-b), #tag', doc_id % 3, ' # no')")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(t.hashtags(text)), ",").alias("tags"))


_FRONT = "concat('---\\ntags: [', coalesce(lang, 'l'), ', ', coalesce(source, 's'), ']\\ncategory: x, ', coalesce(lang, 'l'), '\\n---\\n', coalesce(text, ''))"


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([coalesce(lang, 'l'), coalesce(source, 's'), 'x'])), ',') AS tags, md5(coalesce(text, '')) AS body FROM documents")
def front_matter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FRONT).alias("text"))
    return d.select("doc_id", F.array_join(markdown.front_tags(markdown.front_matter(F.col("text"))), ",").alias("tags"), F.md5(markdown.body(F.col("text")).cast("binary")).alias("body"))


_STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, md5({_STRIPPED}) AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE {_STRIPPED} <> ''")
def paragraph_split(spark, sf_dir):
    """Each line of the text as a paragraph of its own, none gathered with the next."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraph_chunks(text, 1)).alias("chunk_index", "chunk"))
    return made.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("SELECT source || '/' || doc_id || ':0' AS id, source || '/' || doc_id AS path, md5(coalesce(text, '')) AS document, CASE WHEN text IS NULL THEN 1 ELSE 3 END AS n_metadata, coalesce(regexp_matches(text, '[\\w\\x{80}-\\x{10FFFF}]'), false) AS embedded FROM documents WHERE source IS NOT NULL")
def stored_rows(spark, sf_dir):
    """Documents as files of one chunk, those without a text as files without any: ids, metadata without nulls, vectors."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    files = d.select(F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("checksum"), "text")
    kinds = {"chunk_index": "int", "tags": "string", "urls": "string", "section_header": "string", "summary": "string"}
    chunks = files.where("text IS NOT NULL").select("path", "text", *((F.lit(0) if c == "chunk_index" else F.lit("a,b") if c == "tags" else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
    rows = ingest.stored_rows(chunks, files, base.HashEmbedder(64), max_calls=10**9)
    vector = F.exists("embedding", lambda x: x != 0)
    return rows.select("id", "path", F.md5(F.col("document").cast("binary")).alias("document"), F.size("metadata").alias("n_metadata"), vector.alias("embedded"))


@query("SELECT o_orderkey AS id, (o_orderkey % 8) / 4.0 * CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') < 365 THEN 1.25 ELSE 1.0 END * CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0 ELSE 1.0 END AS similarity FROM orders")
def hybrid_recency(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.expr("(o_orderkey % 8) / 4D").alias("similarity"), F.col("o_orderpriority").alias("tags"), F.lit("s").alias("source_document"), F.col("o_orderdate").cast("date").cast("string").alias("date"))
    return r.hybrid_score(rows, ["1-urgent"], ["none"], 2.0, 4.0, 1.25, "date", "1998-01-01").select("id", "similarity")


@query("SELECT doc_id, CAST(greatest(1, length(text) // 3) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(r"""WITH x AS (SELECT doc_id, replace(replace(coalesce(text, ''), 'e' || chr(10), 'e-' || chr(10) || 'x'), chr(9), ' ') || chr(10) || chr(10) || doc_id AS x FROM documents),
j AS (SELECT doc_id, replace(replace(regexp_replace(x, '(\w)-\n(\w)', '\1\2', 'g'), chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)) AS x FROM x)
SELECT doc_id, md5(regexp_replace(replace(replace(x, chr(10), ' '), chr(1), chr(10)), ' +', ' ', 'g')) AS cleaned FROM j""")
def pdf_cleanup(spark, sf_dir):
    """Texts whose lines after an "e" are broken by a hyphen; blank lines stay."""
    text = F.concat(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("e\n"), F.lit("e-\nx")), F.lit("\t"), F.lit(" ")), F.lit("\n\n"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.pdf_cleanup(text).cast("binary")).alias("cleaned"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1) AND NOT (starts_with(source, 'src1') OR lang = 'fr' OR CAST(doc_id AS VARCHAR) LIKE '7%')")
def scan_filter(spark, sf_dir):
    """Files that the scan takes: an allowed suffix, and no part, path or name that an exclusion matches."""
    suffix = F.element_at(F.array(F.lit(".TXT"), F.lit(".md"), F.lit(".pyc"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", "doc_id"), suffix).alias("path"))
    return rows.where(t.extension(F.col("path")).isin("txt", "md") & ~scan.excluded(F.col("path"), ["src1*", "fr", "7*"])).select("doc_id")


@query("SELECT doc_id, '\"' || replace(source, '\"', '\"\"') || ',x\",' || lang || ',\"a\"\"' || doc_id || '\"' AS cell FROM documents")
def list_to_csv(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", t.csv_cell(F.array(F.concat("source", F.lit(",x")), F.col("lang"), F.concat(F.lit('a"'), F.col("doc_id").cast("string")))).alias("cell"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CASE WHEN lang IN ('en', 'fr') THEN lang || ',' ELSE '' END || 'b' END AS items FROM documents")
def llm_list_sanitise(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    reply = F.concat(F.lit(" ['"), "lang", F.lit("', \"b\",, b , zz"), F.expr("if(doc_id % 4 = 0, 'candidates=', '')"), F.lit("] "))
    return d.select("doc_id", F.array_join(t.reply_items(reply, F.array(*(F.lit(x) for x in ("en", "fr", "b")))), ",").alias("items"))


# --- profile ----------------------------------------------------------------------------------------------

_LENS = r"lens AS (SELECT doc_id, length(x) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_replace(x, '\s+', '', 'g') <> '')"


def _profile(spark, sf_dir):
    return profile.profiled(table(spark, sf_dir, "documents"), "doc_id", "text", "n_chars")


@query(f"WITH {_LENS} SELECT count(x) AS n, min(x) AS min_x, max(x) AS max_x, CAST(floor(avg(x)) AS BIGINT) AS mean_x, CAST(floor(median(x)) AS BIGINT) AS median_x FROM lens")
def profile_lengths(spark, sf_dir):
    got = profile.spread(profile.pooled(_profile(spark, sf_dir), "line_lens"))
    return got.withColumns({c: F.col(c).cast("long") for c in ("min_x", "max_x")})


@query("SELECT pct, n_chars AS value FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), (VALUES (10), (50), (80), (100)) AS p(pct) WHERE i = least(n * pct // 100, n - 1)")
def index_percentile(spark, sf_dir):
    return profile.index_percentiles(table(spark, sf_dir, "documents"), [10, 50, 80, 100], "n_chars")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS i, count(*) OVER () AS n FROM documents) WHERE i = n // 2 + 1")
def typical_doc(spark, sf_dir):
    return profile.typical(table(spark, sf_dir, "documents"), "n_chars", "doc_id").select("doc_id", "n_chars")


@query(f"WITH {_LENS}, k AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS i, count(*) OVER () AS n FROM documents) WHERE n < 10 OR (i > n // 10 AND i <= n - n // 10)) SELECT count(x) AS n, min(x) AS min_x, max(x) AS max_x, CAST(floor(avg(x)) AS BIGINT) AS mean_x, CAST(floor(median(x)) AS BIGINT) AS median_x FROM lens WHERE doc_id IN (SELECT doc_id FROM k)")
def middle80(spark, sf_dir):
    got = profile.spread(profile.pooled(profile.middle(_profile(spark, sf_dir), "size", "doc_id"), "line_lens"))
    return got.withColumns({c: F.col(c).cast("long") for c in ("min_x", "max_x")})


_PARAS = r"paras AS (SELECT length(x) AS x FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS x FROM documents) WHERE regexp_replace(x, '\s+', '', 'g') <> '')"


@query(f"""WITH {_PARAS}, b AS (SELECT (SELECT count(*) FROM documents) AS n, least(greatest(CAST(floor(median(x) * 2) AS BIGINT), 512), 2048) AS c FROM paras)
SELECT CAST(c AS INTEGER) AS chunk_size, CAST(greatest(c // 2, 256) AS INTEGER) AS min_chunk_size, CAST(greatest(floor(c * 0.2), 128) AS INTEGER) AS chunk_overlap,
  CAST(least(100, greatest(10, n // 2)) AS INTEGER) AS batch_size, CAST(greatest(c, 2048) AS INTEGER) AS max_length, CAST(least(100, greatest(10, n // 2)) AS INTEGER) AS embedding_batch_size,
  CAST(CASE WHEN n < 1000 THEN CASE WHEN c > 1500 THEN 10 ELSE 20 END WHEN n < 10000 THEN CASE WHEN c > 1500 THEN 30 ELSE 50 END ELSE 75 END AS INTEGER) AS top_k, CAST(greatest(c, 2048) * 4 AS INTEGER) AS context_window FROM b""")
def recommend(spark, sf_dir):
    return profile.recommended(_profile(spark, sf_dir))


# --- the rest ---------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def interaction_pairs(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def interaction_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_detection(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS batch FROM documents")
def batch_assign(spark, sf_dir):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(place / 100).alias("batch"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'p' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS row_id FROM embeddings")
def row_ids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), catalog.row_id(F.lit(""), F.expr("if(vec_id % 2 = 0, concat('p', vec_id), '')"), F.col("vec_id")).alias("row_id"))
