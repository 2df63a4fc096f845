"""Queries about files, Markdown documents and the stored collection, beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.models import base
from lexiforge.operators import catalog, chunking, markdown
from lexiforge.operators import retrieval as r
from lexiforge.plans.catalogue import query, table
from lexiforge.sources import readers, scan
from lexiforge.sources.collection import Collection
from lexiforge.sources.shared import new_path
from lexiforge.streaming import ingest

# --- the collection ---------------------------------------------------------------------------------------

_FILES = "files AS (SELECT doc_id, coalesce(source, 's') || '/' || coalesce(lang, 'l') || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path, coalesce(lang, '') || ', ' || coalesce(source, '') || ', X' || (doc_id % 4) AS tags, coalesce(text, '') AS text FROM documents)"
_KEPT = f"""{_FILES}, kept AS (
  SELECT path, path || ':0' AS id, CASE WHEN doc_id % 5 = 0 THEN 'new ' || text ELSE text END AS document, tags FROM files
  WHERE NOT regexp_matches(path, '^src1.*/en/') AND NOT path LIKE '%7.md' AND tags <> 'fr, src2, X1')"""


def _files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.expr("coalesce(source, 's') || '/' || coalesce(lang, 'l') || '/' || doc_id || if(doc_id % 3 = 0, '.md', '.txt')")
    tags = F.expr("coalesce(lang, '') || ', ' || coalesce(source, '') || ', X' || (doc_id % 4)")
    return d.select("doc_id", path.alias("path"), tags.alias("tags"), F.coalesce("text", F.lit("")).alias("document"))


def _changed(spark, sf_dir) -> tuple[Collection, DataFrame]:
    """A collection of all documents, after a fifth of them was replaced, some removed by patterns and some by a filter."""
    store = Collection(spark, new_path(spark, "collection"), buckets=8)
    rows = _files(spark, sf_dir).select(
        F.concat("path", F.lit(":0")).alias("id"), "path", F.sha2("document", 256).alias("checksum"), "document", "tags",
        F.array(F.lit(0.0).cast("float")).alias("embedding"), F.create_map(F.lit("path"), F.col("path")).alias("metadata"), "doc_id",
    )
    store.append(rows)
    store.append(rows.where("doc_id % 5 = 0").withColumn("document", F.concat(F.lit("new "), "document")))
    report = store.remove(["src1*/en/*", "*7.md", "nothing*"])
    store.delete(spec={"tags": "fr, src2, X1"})
    return store, report


@query(f"WITH {_KEPT} SELECT id, path, md5(document) AS document, tags FROM kept")
def collection_rows(spark, sf_dir):
    store, _ = _changed(spark, sf_dir)
    return store.rows().select("id", "path", F.md5(F.col("document").cast("binary")).alias("document"), "tags")


@query(f"""WITH {_KEPT}, tagged AS (SELECT DISTINCT path, lower(trim(unnest(string_split(tags, ',')))) AS tag FROM kept)
SELECT 'rows' AS view, '' AS key, count(*) AS n FROM kept UNION ALL SELECT 'documents', '', count(*) FROM kept
UNION ALL SELECT 'types', list_last(string_split(path, '.')), count(*) FROM kept GROUP BY 2 UNION ALL SELECT 'tags', tag, count(*) FROM tagged WHERE tag <> '' GROUP BY 2""")
def collection_views(spark, sf_dir):
    store, _ = _changed(spark, sf_dir)
    out = [store.counts(v).select(F.lit(v).alias("view"), "key", "n") for v in ("rows", "documents", "types", "tags")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"""WITH {_FILES}, p AS (SELECT * FROM (VALUES ('src1*/en/*', '^src1.*/en/'), ('*7.md', '7[.]md$'), ('nothing*', '^nothing')) AS t(pattern, regex))
SELECT pattern, path, CASE WHEN path IS NULL THEN 'not_found' ELSE 'removed' END AS status FROM p LEFT JOIN files ON regexp_matches(path, regex)""")
def collection_removed(spark, sf_dir):
    _, report = _changed(spark, sf_dir)
    return report.select("pattern", F.regexp_replace("pattern", "^/", "").alias("p"), "path", "status").select(F.col("p").alias("pattern"), "path", "status")


# --- files ------------------------------------------------------------------------------------------------

_SUFFIXES = ["txt", "md", "CSV", "pdf", "Png", "markdown", "zip", ""]


def _named(spark, sf_dir) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("s")), F.lit("/f.x"), F.col("doc_id").cast("string"), F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix)))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))


_NAMED = f"named AS (SELECT doc_id, '/data/' || coalesce(source, 's') || '/f.x' || doc_id || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '.' || {_SUFFIXES!r}[doc_id % 8 + 1] END AS path, coalesce(n_chars, 0) AS size FROM documents)"


@query(f"WITH {_NAMED} SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'csv' WHEN 3 THEN 'pdf' WHEN 4 THEN 'image' WHEN 5 THEN 'markdown' ELSE 'unsupported' END AS kind FROM named")
def file_kinds(spark, sf_dir):
    return readers.routed(_named(spark, sf_dir)).select("doc_id", "kind")


@query(f"WITH {_NAMED} SELECT list_last(string_split(lower(path), '.')) AS extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS smallest, max(size) AS largest FROM named GROUP BY 1")
def extension_sizes(spark, sf_dir):
    return catalog.extension_sizes(_named(spark, sf_dir))


@query(f"""WITH {_NAMED} SELECT doc_id, path, substr(path, 7) AS relative_path, regexp_replace(path, '/[^/]*$', '') AS directory, list_last(string_split(path, '/')) AS filename_full,
regexp_replace(list_last(string_split(path, '/')), '[.][^.]+$', '') AS filename_stem, lower(list_last(string_split(path, '.'))) AS file_type, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS last_modified FROM named""")
def file_facts(spark, sf_dir):
    rows = _named(spark, sf_dir).withColumn("modified", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(doc_id % 400 AS int))"))
    return rows.select("doc_id", *scan.file_metadata(F.col("path"), F.col("modified"), "/data")).drop("created_at")


@query("SELECT page_id, array_to_string(regexp_extract_all(html || ' ' || url, 'https?://[\\w\\.-]+(?:/[\\w\\.-]*)*'), ' ') AS urls FROM pages")
def caption_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(t.urls(F.concat_ws(" ", "html", "url"), t.URL_CAPTION), " ").alias("urls"))


@query("SELECT doc_id, md5('id,text' || chr(10) || doc_id || ',' || coalesce(text, '')) AS text, 'id,text' AS header_fields, 1 AS row_count FROM documents")
def csv_tables(spark, sf_dir):
    cells = F.expr("concat('id,text\\n', doc_id, ',\"', replace(coalesce(text, ''), '\"', '\"\"'), '\"\\n')")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), cells.alias("text"))
    made = readers.csv_tables(files)
    return made.select(F.col("path").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("header_fields", ",").alias("header_fields"), "row_count")


# --- Markdown ---------------------------------------------------------------------------------------------


def _parts_sql(source: str, size: int) -> str:
    """CTEs q (doc_id, parts): the text x of `source` in parts of `size`, a cut at a list moved back."""
    listed = "regexp_matches(trim({}), '^([-*+]|[0-9]+[.]|[|])')"
    last = "coalesce(a.cur[-1], '')"
    touches = f"({listed.format(f'list_last(string_split({last}, chr(10)))')} OR {listed.format('string_split(x.s, chr(10))[1]')})"
    empty = "{'out': CAST([] AS VARCHAR[]), 'cur': CAST([] AS VARCHAR[]), 'n': 0, 's': %s}"
    return f"""
q1 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\\s+([A-Z0-9#*-])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '\\n+$', '')), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13)) <> '') AS ss FROM {source}),
q2 AS (SELECT doc_id, list_reduce(list_prepend({empty % "''"}, list_transform(ss, lambda s: {empty % 's'})),
  lambda a, x: CASE WHEN a.n + length(x.s) > {size} AND len(a.cur) > 0 THEN CASE WHEN {touches} AND len(a.cur) > 1
      THEN {{'out': list_append(a.out, array_to_string(a.cur[:-2], ' ')), 'cur': [{last} || ' ' || x.s], 'n': CAST(length({last} || ' ' || x.s) AS INTEGER), 's': ''}}
      ELSE {{'out': list_append(a.out, array_to_string(a.cur, ' ')), 'cur': [x.s], 'n': CAST(length(x.s) AS INTEGER), 's': ''}} END
    ELSE {{'out': a.out, 'cur': list_append(a.cur, x.s), 'n': CAST(a.n + length(x.s) AS INTEGER), 's': ''}} END) AS a FROM q1),
q AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(a.cur) > 0 THEN list_append(a.out, array_to_string(a.cur, ' ')) ELSE a.out END, lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '') AS parts FROM q2)"""


_LISTED = "listed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), ', ', '.' || chr(10) || '- ') ELSE coalesce(text, '') END AS x FROM documents)"


@query(f"WITH {_LISTED}, {_parts_sql('listed', 700)} SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, md5(parts[i]) AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM q)")
def section_parts(spark, sf_dir):
    text = F.expr("if(doc_id % 2 = 0, replace(coalesce(text, ''), ', ', '.\\n- '), coalesce(text, ''))")
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sub_chunks(text, 700)).alias("place", "part"))
    return made.select("doc_id", "place", F.md5(F.col("part").cast("binary")).alias("part"))


_SECTION = "sections AS (SELECT doc_id, regexp_replace('# ' || coalesce(source, 's') || chr(10) || coalesce(text, ''), '(\\n[^\\S\\n]*)+$', '') AS x FROM documents)"


@query(f"""WITH {_SECTION}, {_parts_sql('sections', 3072)}, made AS (SELECT doc_id, CASE WHEN length(x) <= 3072 THEN [regexp_replace(x, '^\\s+|\\s+$', '', 'g')] ELSE parts END AS parts FROM sections JOIN q USING (doc_id))
SELECT d.doc_id, array_to_string(list_sort(list_distinct([coalesce(lang, 'l'), 'x'])), ',') AS tags, CAST(len(parts) AS BIGINT) AS chunk_count, CAST(coalesce(list_sum(list_transform(parts, lambda c: length(c))), 0) AS BIGINT) AS total_tokens FROM documents d JOIN made USING (doc_id)""")
def markdown_documents(spark, sf_dir):
    text = F.expr("concat('---\\ntags: x, ', coalesce(lang, 'l'), '\\n---\\n# ', coalesce(source, 's'), '\\n', coalesce(text, ''))")
    return markdown.documents(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("""WITH b AS (SELECT doc_id, 1 AS block, coalesce(source, 's') AS h, string_split('#### ' || coalesce(source, 's') || chr(10) || coalesce(text, ''), chr(10)) AS l FROM documents
  UNION ALL SELECT doc_id, 2, coalesce(lang, 'l'), string_split('#### ' || coalesce(lang, 'l') || chr(10) || coalesce(text, '') || chr(10) || 'end', chr(10)) FROM documents),
s AS (SELECT *, length(regexp_replace(array_to_string(l, chr(10)), '^\\s+|\\s+$', '', 'g')) AS size FROM b),
p AS (SELECT *, CASE WHEN size > 2048 THEN greatest(1, len(l) // (size // 2048 + 1)) ELSE len(l) END AS step FROM s),
e AS (SELECT doc_id, block, h, k, regexp_replace(array_to_string(list_slice(l, k, k + step - 1), chr(10)), '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT *, unnest(range(1, len(l) + 1, step)) AS k FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, k) - 1 AS INTEGER) AS chunk_index, h AS section_header, md5(x) AS chunk FROM e WHERE x <> ''""")
def header_blocks(spark, sf_dir):
    text = F.expr("concat('dropped\\n#### ', coalesce(source, 's'), '\\n', coalesce(text, ''), '\\n#### ', coalesce(lang, 'l'), '\\n', coalesce(text, ''), '\\nend')")
    made = markdown.header_blocks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text", 2048)
    return made.select("doc_id", "chunk_index", "section_header", F.md5(F.col("text").cast("binary")).alias("chunk"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([coalesce(lang, 'l'), coalesce(source, 's')], ['z' || (doc_id % 3)], regexp_extract_all(' ' || coalesce(text, ''), '(?:^|[^#\\w\\x{80}-\\x{10FFFF}])#([A-Za-z0-9_-]*[A-Za-z0-9_])', 1)))), ',') AS tags FROM documents")
def union_tags(spark, sf_dir):
    front = F.expr("concat('---\\ntags: [', coalesce(lang, 'l'), ', ', coalesce(source, 's'), ']\\n---\\n ', coalesce(text, ''), ' #z', doc_id % 3, ' end')")
    own = table(spark, sf_dir, "documents").select("doc_id", front.alias("text"))
    tags = F.array_union(markdown.front_tags(markdown.front_matter(F.col("text"))), t.hashtags(markdown.body(F.col("text"))))
    return own.select("doc_id", t.csv_cell(F.array_sort(tags)).alias("tags"))


@query("""WITH g AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+$', '')), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend({'out': CAST([] AS VARCHAR[]), 'cur': CAST([] AS VARCHAR[]), 'n': 0, 's': ''}, list_transform(ps, lambda s: {'out': CAST([] AS VARCHAR[]), 'cur': CAST([] AS VARCHAR[]), 'n': 0, 's': s})),
  lambda a, x: CASE WHEN a.n + length(x.s) > 900 AND len(a.cur) > 0 THEN {'out': list_append(a.out, array_to_string(a.cur, chr(10))), 'cur': [x.s], 'n': CAST(length(x.s) AS INTEGER), 's': ''}
    ELSE {'out': a.out, 'cur': list_append(a.cur, x.s), 'n': CAST(a.n + length(x.s) AS INTEGER), 's': ''} END) AS a FROM g),
c AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(a.cur) > 0 THEN list_append(a.out, array_to_string(a.cur, chr(10))) ELSE a.out END, lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '') AS cs FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, md5(cs[i]) AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)""")
def paragraph_groups(spark, sf_dir):
    """Lines as paragraphs, gathered up to 900 characters."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraph_chunks(text, 900)).alias("chunk_index", "chunk"))
    return made.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


_MARKS = "■*•I—–·●-"


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS x, len(ls) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT *, regexp_replace(regexp_replace(x, '(\d)\s+(\d)', '\1.\2', 'g'), '(\d)\s+(\d)', '\1.\2', 'g') AS whole FROM l WHERE x <> ''),
k AS (SELECT *, regexp_matches(whole, '^[0-9]+(?:[.][0-9]+)*(?:\s+|[.])+.') AS numbered, regexp_matches(whole, '^(?:[{_MARKS}]|[0-9]+[.]|[a-zA-Z][)])\s+') AS item, ['', '*', '**', '***'][doc_id % 4 + 1] AS stars FROM w),
m AS (SELECT doc_id, i, CASE WHEN numbered THEN chr(10) || '#### ' || whole || chr(10) WHEN item THEN '- ' || regexp_replace(whole, '^(?:[{_MARKS}]|[0-9]+[.]|[a-zA-Z][)])\s+', '')
  WHEN i = 0 OR n = 1 THEN '# ' || x WHEN i = 1 THEN '## ' || x WHEN regexp_matches(x, '^[{_MARKS}]') THEN '- ' || regexp_replace(substr(x, 2), '^\s+', '') ELSE stars || x || stars END AS made FROM k)
SELECT doc_id, md5(string_agg(made, chr(10) ORDER BY i)) AS markdown FROM m GROUP BY 1""")
def span_markdown(spark, sf_dir):
    """Each line of a text as one span: the first in the largest size, the second in the next one, the rest in the smallest."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    spans = lines.selectExpr(
        "cast(doc_id AS string) AS doc", "cast(i div 50 AS int) AS page", "cast(i % 50 div 5 AS int) AS block", "cast(i % 5 AS int) AS line", "0 AS span", "text",
        "CASE i WHEN 0 THEN 18D WHEN 1 THEN 14D ELSE 10D END AS size", "cast(doc_id % 4 AS int) AS flags", "72D AS x0",
    )
    made = markdown.spans_to_markdown(spans)
    return made.select(F.col("doc").cast("long").alias("doc_id"), F.md5(F.col("markdown").cast("binary")).alias("markdown"))


# --- logs, searches, models -------------------------------------------------------------------------------


@query("""SELECT CAST(conv_id AS VARCHAR) AS day, md5('# ' || conv_id || chr(10) || chr(10) || string_agg('## ' || lpad(CAST(turn AS VARCHAR), 6, '0') || chr(10) || chr(10) || '**Question:** ' || role || chr(10) || chr(10) || '**Answer:** ' || text || chr(10), chr(10) ORDER BY turn, role, text)) AS markdown
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id""")
def interaction_days(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL")
    log = c.select(F.col("conv_id").cast("string").alias("day"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("ts"), F.col("role").alias("question"), F.col("text").alias("answer"))
    return ingest.day_logs(log).select("day", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@query("""SELECT doc_id, CASE WHEN lower(coalesce(lang, '')) = 'fr' THEN 0 WHEN contains(lower(coalesce(source, '')), 'src1') THEN 1 ELSE 2 END AS place FROM documents
WHERE lower(coalesce(lang, '')) = 'fr' OR contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(source, '')), '9')""")
def candidate_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.create_map(F.lit("tags"), F.concat(F.coalesce("lang", F.lit("")), F.lit(",#")), F.lit("source"), F.coalesce("source", F.lit(""))).alias("metadata"))
    return r.candidates(rows, ["fr"], ["SRC1", "9"], "doc_id")


class _FirstWords:
    """A model that lists the first three words of a caption, in quotes."""

    def answer(self, prompt: str, temperature: float = 0.2, max_tokens: int = 512) -> str:
        return ", ".join(f'"{w}"' for w in prompt.partition("Caption: ")[2].split(" ")[:3])


@query(r"""WITH w AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN array_to_string(list_transform(string_split(text, ' ')[1:3], lambda w: '"' || w || '"'), ', ') END AS reply FROM documents),
b AS (SELECT doc_id, reply IS NULL OR regexp_matches(reply, '=|None|prompt_token_count|response_id|model_version') AS bad, regexp_replace(reply, '^[\[\]]+|[\[\]]+$', '', 'g') AS body FROM w),
i AS (SELECT doc_id, bad, list_transform(string_split(body, ','), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')) AS items FROM b)
SELECT doc_id, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(items, lambda x: x <> ''))), '|') END AS items FROM i""")
def model_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return base.extracted(d, _FirstWords(), "image_tags").select("doc_id", F.array_join(F.array_sort("items"), "|").alias("items"))
