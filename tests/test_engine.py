import csv
import fnmatch
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiforge.config import Config
from lexiforge.errors import CollectionError, ConfigError, ScanError
from lexiforge.functions import text as t
from lexiforge.functions import vector as v
from lexiforge.functions.predicates import where
from lexiforge.models.base import EchoAnswerer, HashEmbedder, RateLimited, Timetable, patiently, prompt
from lexiforge.operators import catalog, chunking, markdown, profile
from lexiforge.operators import retrieval as r
from lexiforge.plans.rag import Settings, ask, shown
from lexiforge.sources.collection import Collection
from lexiforge.sources.readers import chunked, csv_tables
from lexiforge.sources.scan import excluded_from_right, file_metadata, scan_files
from lexiforge.streaming.ingest import day_logs, ingest, left_open, log_interaction, stream


def one(spark, column, **values):
    """The value of an expression over one row."""
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- chunking ---------------------------------------------------------------------------------------------


def said_chunks(text, most, least, overlap):
    """The chunking rule, said again in plain Python."""
    text = text.strip()
    if len(text) <= least:
        return [text]
    out, cur = [], []
    for s in (s for s in re.split(r"(?<=[.!?])\s+", text) if s):
        if cur and sum(map(len, cur)) + len(s) > most:
            out.append(" ".join(cur))
            tail = []
            while overlap > 0 and len(cur) > 1 and len(tail) < len(cur) and sum(map(len, tail)) < overlap:
                tail = cur[len(cur) - len(tail) - 1 :]
            cur = tail
        cur = [*cur, s]
    out += [" ".join(cur)] if cur else []
    return [c for c in out if len(c) >= least or len(out) == 1]


def test_sentence_chunks_follow_the_rule(spark):
    rng = random.Random(1)
    texts = ["", "  \n ", "A. " * 10 + "B. " * 10 + "C. " * 10, "This is sentence one. This is sentence two! Is this sentence three? Yes.", "x" * 200, "a. b. c"]
    texts += ["".join(rng.choice(["word", "a", ". ", "! ", "? ", " ", "\n", "é."]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for sizes in ((50, 10, 10), (40, 20, 60), (30, 5, 0)):
        got = {x.i: x.c for x in df.select("i", chunking.sentence_chunks(F.col("text"), *sizes).alias("c")).collect()}
        assert got == {i: said_chunks(x, *sizes) for i, x in enumerate(texts)}


def test_text_chunks_have_their_fields(spark):
    df = spark.createDataFrame([("a", "See https://x.org/a. " * 30 + 'And "this". ' * 20)], "path string, text string")
    rows = chunking.text_chunks(df, "path", max_size=200, min_size=20, overlap=20).orderBy("chunk_index").collect()
    assert [x.chunk_index for x in rows] == list(range(len(rows))) and len(rows) > 3
    assert rows[1].start_offset == len(rows[0].text) and rows[0].end_offset == len(rows[0].text) - 1
    assert rows[0].urls == "https://x.org/a." and rows[0].url_contexts[0].context == "paragraph" and rows[0].topics == ["Unknown"]


def test_paragraphs_and_sub_chunks(spark):
    assert one(spark, chunking.paragraph_chunks(F.col("x"), 10), x="\n \naaa\nbbb\n\nccc\n \n\nddddddddd\n") == ["aaa\nbbb\nccc", "ddddddddd"]
    got = one(spark, chunking.sub_chunks(F.col("x"), 40), x="First sentence here. Second one here.\n- item. Third sentence is long enough. Four.")
    assert " ".join(got).split() == "First sentence here. Second one here. - item. Third sentence is long enough. Four.".split() and len(got) > 1


# --- markdown ---------------------------------------------------------------------------------------------


def test_markdown_chunks(spark):
    text = "---\ntags: [One, two]\ncategory: x, y\n---\nlost\n# Header 1\nThis is a test.\n\n## Header 2\nAnother #tag é#no ##no [l](http://a.b/c) http://d.e"
    df = spark.createDataFrame([("a", text), ("b", "no header\n\nsecond #tag"), ("c", ""), ("d", "---\ntags: [a\n---\n# H\n\n")], "path string, text string")
    rows = markdown.chunks(df, "path").orderBy("path", "chunk_index").collect()
    a = [x for x in rows if x.path == "a"]
    assert [x.text.split("\n")[0] for x in a] == ["# Header 1", "## Header 2"]
    assert a[1].section_hierarchy == ["Header 1", "Header 2"] and a[1].tags == "One,tag,two,x,y" and a[0].tags == "One,two,x,y"
    assert a[1].urls == "http://a.b/c,http://d.e" and [u.context for u in a[1].url_contexts] == ["markdown_link", "raw_url", "raw_url"]
    assert (a[0].start_offset, a[0].end_offset) == (1, 3)
    b = [x for x in rows if x.path == "b"]
    assert len(b) == 1 and b[0].text == "no header\nsecond #tag" and b[0].tags == "" and b[0].section_header == ""
    docs = {x.path: x for x in markdown.documents(df, "path").collect()}
    assert docs["c"].chunk_count == 0 and docs["a"].chunk_count == 2 and docs["d"].chunk_count == 1


def test_long_sections_are_cut(spark):
    df = spark.createDataFrame([("a", "# H\n" + "A sentence that is here. " * 200)], "path string, text string")
    rows = markdown.chunks(df, "path").collect()
    assert len(rows) > 1 and all(len(x.text) <= 3400 and x.section_header == "H" for x in rows)


def test_pdf_rules(spark):
    spans = [("d", 0, 0, 0, 0, "Title", 20.0, 0, 1.0), ("d", 0, 1, 0, 0, "Part", 15.0, 0, 1.0), ("d", 0, 2, 0, 0, "1.", 10.0, 0, 1.0), ("d", 0, 2, 0, 1, "2", 10.0, 0, 1.0), ("d", 0, 2, 0, 2, "Scope", 10.0, 0, 1.0),
             ("d", 0, 3, 0, 0, "• first", 10.0, 0, 5.0), ("d", 0, 4, 0, 0, "• deep", 10.0, 0, 9.0), ("d", 0, 5, 0, 0, "• again", 10.0, 0, 5.5), ("d", 1, 0, 0, 0, "bold", 10.0, 2, 1.0), ("d", 1, 0, 0, 1, " ", 10.0, 0, 1.0), ("d", 1, 0, 0, 2, "both", 10.0, 3, 1.0)]
    md = markdown.spans_to_markdown(spark.createDataFrame(spans, markdown.SPANS)).first().markdown
    assert md.split("\n") == ["# Title", "## Part", "", "#### 1.2 Scope", "", "- first", "  - deep", "- again", "**bold**", "***both***"]
    blocks = markdown.header_blocks(spark.createDataFrame([("d", md + "\n" + "line\n" * 40)], "doc string, markdown string"), "doc", "markdown", 60).collect()
    assert {b.section_header for b in blocks} == {"1.2 Scope"} and len(blocks) > 1 and "Title" not in blocks[0].text


# --- text, globs, cells -----------------------------------------------------------------------------------


def test_globs_are_fnmatch(spark):
    names = ["", "a", "[a", "a]", "src/b.md", "x\ny.md", "a$(b", "a\\b", "!a", "src1/x/y.md", "A.MD"]
    patterns = ["*", "*.md", "src*", "[a", "[]]", "[!]a]", "s?c*/*", "a$(*", "a\\b", "*[.]md", "x\ny*", "[!a]*"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    for p in patterns:
        assert {x.x for x in df.where(t.glob(F.col("x"), p)).collect()} == {x for x in names if fnmatch.fnmatchcase(x, p)}, p


def test_csv_cells_match_the_csv_module(spark):
    def said(items):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_MINIMAL).writerow(items)
        return out.getvalue().strip()

    rows = [["a"], [""], [], ["a,b", 'q"x', "l\nm"], ["a", "", "b"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<string>")
    got = {x.i: x.c for x in df.select("i", t.csv_cell(F.col("x")).alias("c")).collect()}
    assert got == {i: said(x) for i, x in enumerate(rows)}


def test_small_text_rules(spark):
    assert one(spark, t.summary(F.col("x")), x="One two. Three " + "w " * 30).split() == ("One two. Three " + "w " * 17).split()
    assert one(spark, t.summary(F.col("x")), x="One two three four five. Six") == "One two three four five"
    assert [one(spark, t.extension(F.col("x")), x=x) for x in ("a/.bashrc", "a/b.", "a/b.TXT", "a.b/c")] == ["", "", "txt", ""]
    assert one(spark, t.redacted(F.col("x")), x="abcdefghij") == "abcd...ghij"
    assert one(spark, t.reply_items(F.col("x")), x=" [a, 'b', \"c\",,a] ") == ["a", "b", "c"]
    assert one(spark, t.reply_items(F.col("x")), x="usage_metadata=1") == []
    assert one(spark, t.pdf_cleanup(F.col("x")), x="hy-\nphen a\nb\n\nc  d") == "hyphen a b\n\nc d"
    assert one(spark, t.token_estimate(F.col("x")), x="ab") == 1


# --- vectors, retrieval -----------------------------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    got = [(x.c, x.d) for x in df.select(v.cosine(F.col("a"), F.col("b")).alias("c"), v.squared_l2(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == (0.0, 1.0) and abs(got[1][0] - 1) < 1e-9 and got[2] == (-1.0, 4.0)
    with pytest.raises(Exception, match="width"):
        df.select(v.dot(F.col("a"), F.array(F.lit(1.0)))).collect()


def sources(spark, rows):
    df = spark.createDataFrame(rows, "id long, document string, source_document string, similarity double, tags string, date string")
    return df.withColumn("rank", F.col("id")).withColumn("embedding", F.array(F.lit(1.0)))


def test_scoring_rules(spark):
    rows = [(1, "a", "d1", 0.5, "Fr,x", "2024-01-02"), (2, "b", "lib/d2.md", 0.5, None, "1700000000"), (3, "c", "d3", 0.4, "no", "never"), (4, "d", "d3", 0.4, "", "2020-01-01")]
    got = {x.id: round(x.boost, 6) for x in r.hybrid_score(sources(spark, rows), ["FR"], ["lib/*"], 1.5, 1.1, 2.0, "date", "2024-06-01").collect()}
    assert got == {1: 3.0, 2: 2.2, 3: 1.0, 4: 1.0}
    strict = {x.id: x.boost for x in r.hybrid_score(sources(spark, rows), ["fr"], [], strict=True).collect()}
    assert set(strict.values()) == {1.0}
    assert [x.id for x in r.best_of_document(sources(spark, rows)).orderBy("id").collect()] == [1, 2, 3]


def test_thresholds_and_budget(spark):
    rows = [(1, "w w w", "a", 0.2, "", None), (2, "w", "b", 0.1, "KEY", None), (3, "w", "c", 0.19, "", None), (4, "", "d", 0.9, "", None), (5, "w " * 9, "e", 0.3, "", None)]
    kept = r.filtered(sources(spark, rows), ["key"])
    assert [x.id for x in kept.orderBy("place").collect()] == [4, 5, 1, 2]
    assert [x.id for x in r.within_budget(kept, 9).orderBy("place").collect()] == [4, 5]
    assert [x.id for x in r.within_budget(kept, 8).orderBy("place").collect()] == [4]
    assert r.context_text(r.within_budget(kept, 9)).first().context == "\n---\n\n---\n" + "w " * 9


def test_top_k(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3)], i) for i in range(9)], "id long, embedding array<float>, label int")
    assert [x.id for x in r.top_k(df, [1.0, 0.0], 4).collect()] == [0, 3, 6, 1]
    assert [x.id for x in r.top_k(df, [1.0, 0.0], 0, spec={"label": {"$gt": 3}}).collect()] == [6, 4, 7, 5, 8]
    q = df.where("id < 2").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    assert r.top_k_batch(df, q, 3).count() == 6
    with pytest.raises(ValueError):
        where({"label": {"$near": 1}})


# --- profile ----------------------------------------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([(i, "x" * i + "\n\n y\r\n \n", i) for i in range(1, 11)], "id long, text string, size long")
    p = profile.profiled(df, "id", "text", "size")
    assert p.where("id = 3").first().line_lens == [3, 2] and p.where("id = 3").first().para_count == 2
    values = {x.pct: x.value for x in profile.index_percentiles(df, [0, 50, 80, 100], "size").collect()}
    assert values == {0: 1, 50: 6, 80: 9, 100: 10} and profile.index_percentiles(df.limit(0), [80], "size").count() == 0
    assert profile.typical(df, "size", "id").first().id == 6
    assert [x.id for x in profile.middle(df, "size", "id").orderBy("id").collect()] == list(range(2, 10))
    assert profile.middle(df.limit(5), "size", "id").count() == 5
    assert profile.recommended(p).first().chunk_size == 512 and "chunk_size" in profile.report(p)
    assert profile.recommended(p.limit(0)).first().top_k == 75


# --- files, collection, ingest ----------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "__pycache__").mkdir(parents=True)
    for name, text in {"a.txt": "hello there. " * 5, "b.md": "# H\nworld #tag", "c.pdf": "nope", "__pycache__/d.txt": "skip", "t.csv": "a,b\n1,2\n3,4", "x.svg": "<svg/>", "bad.txt": b"\xff\xfe\xfa"}.items():
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def test_scan(spark, tree):
    rows = scan_files(spark, str(tree), extensions=["txt", "md"], exclude=["__pycache__", "bad*"]).collect()
    assert sorted(x.path.rpartition("/")[2] for x in rows) == ["a.txt", "b.md"] and all(len(x.checksum) == 64 and x.size > 0 for x in rows)
    assert scan_files(spark, str(tree / "a.txt")).count() == 1
    meta = scan_files(spark, str(tree), "a.txt").select(*file_metadata(F.col("path"), F.col("modified"), str(tree))).first()
    assert (meta.relative_path, meta.filename_stem, meta.file_type, meta.directory) == ("a.txt", "a", "txt", str(tree))
    with pytest.raises(ScanError):
        scan_files(spark, str(tree / "none"))
    with pytest.raises(ScanError):
        scan_files(spark, str(tree), algorithm="crc")
    df = spark.createDataFrame([("r/node/a.py",), ("r/x/node/b",), ("r/nodes/c",)], "p string")
    assert [x.p for x in df.where(excluded_from_right(F.col("p"), ["node"])).collect()] == ["r/node/a.py", "r/x/node/b"]


def test_csv_and_router(spark, tree):
    files = scan_files(spark, str(tree), content=True)
    chunks, rejects = chunked(files)
    kinds = {x.path.rpartition("/")[2]: x for x in chunks.collect()}
    assert {"a.txt", "b.md", "t.csv"} == set(kinds) and kinds["b.md"].tags == "tag"
    assert {x.path.rpartition("/")[2]: x.reason for x in rejects.collect()} == {"c.pdf": "unreadable PDF: not a PDF file", "x.svg": "unsupported file type", "bad.txt": "not UTF-8"}
    t_ = csv_tables(spark.createDataFrame([("p", 'h1,"h,2"\n"x\ny",2\n'), ("q", "")], "path string, text string")).orderBy("path").collect()
    assert t_[0].header_fields == ["h1", "h,2"] and t_[0].row_count == 1 and t_[0].text == "h1,h,2\nx\ny,2" and t_[1].row_count == 0


def test_ingest_twice_is_ingest_once_and_removal(spark, tree, tmp_path):
    store, model = Collection(spark, str(tmp_path / "store"), buckets=4), HashEmbedder(16)
    files = scan_files(spark, str(tree), exclude=["__pycache__"], content=True)
    rejects = ingest(files, store, model).collect()
    assert len(rejects) == 3
    first = sorted((x.id, x.checksum) for x in store.rows().collect())
    assert [i.rpartition("/")[2] for i, _ in first] == ["a.txt:0", "b.md:0", "t.csv:0"]
    ingest(files, store, model)
    assert sorted((x.id, x.checksum) for x in store.rows().collect()) == first
    (tree / "a.txt").write_text("changed now")
    ingest(scan_files(spark, str(tree), exclude=["__pycache__"], content=True), store, model)
    assert store.rows().where("id LIKE '%a.txt:0'").first().document == "changed now" and store.rows().count() == 3
    assert store.has(first[1][1]) and not store.has("none") and store.tags() == ["tag"]
    assert store.search(model.embed(["changed now"])[0], 1).first().document == "changed now"
    answer = ask("what has changed now?", store.rows(), model, EchoAnswerer(), Settings(min_similarity=0.01, root=str(tree)))
    assert answer.success and answer.sources[0].source_document == "a.txt" and "a.txt (similarity" in shown(answer)
    report = {(x.pattern, x.status) for x in store.remove(["*.md", "*.zip"], str(tree)).collect()}
    assert report == {("*.md", "removed"), ("*.zip", "not_found")} and store.rows().count() == 2
    store.delete(spec={"path": str(tree / "a.txt")})
    assert store.rows().count() == 1
    with pytest.raises(CollectionError):
        store.delete()
    assert not ask(" ", store.rows(), model, EchoAnswerer()).success
    store.drop()
    assert Collection(spark, str(tmp_path / "store")).rows().count() == 0


def test_a_write_that_dies_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(6).selectExpr("concat('p', id, ':0') AS id", "concat('p', id) AS path", "string(id) AS checksum", "concat('text ', id) AS document", "'t' AS tags", "array(1f, 0f) AS embedding", "map('k', 'v') AS metadata")
    store = Collection(spark, str(tmp_path / "s"), buckets=2)
    store.append(rows)
    before = sorted(r.document for r in store.rows().collect())
    changed = rows.withColumn("document", F.concat("document", F.lit(" new")))

    def die(*a, **k):
        raise OSError("lost")

    for step in ("_write", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(Collection, step, die)
            with pytest.raises(OSError):
                Collection(spark, str(tmp_path / "s")).append(changed)
        assert sorted(r.document for r in Collection(spark, str(tmp_path / "s")).rows().collect()) == before
    bad = changed.withColumn("document", F.expr("if(id = 'p3:0', raise_error('embedder failed'), document)"))
    with pytest.raises(Exception, match="embedder failed"):
        store.append(bad)
    assert sorted(r.document for r in store.rows().collect()) == before
    (tmp_path / "s" / "corpus" / "state-000000000009.json").write_text('{"parts": {')  # a state whose writer died
    assert sorted(r.document for r in store.rows().collect()) == before
    store.append(changed)
    assert {r.document for r in store.rows().collect()} == {f"{x} new" for x in before}
    store.delete(ids=["p1:0"])
    assert store.rows().count() == 5
    brief = Collection(spark, str(tmp_path / "s"), retention=0)
    brief.append(changed.where("id = 'p2:0'"))
    assert len(list((tmp_path / "s" / "corpus").glob("rows-*"))) <= 5 and brief.rows().count() == 5


def test_each_chunk_is_embedded_once_and_open_files_are_done_again(spark, tmp_path):
    class Counting(HashEmbedder):
        def embed(self, texts):
            with open(tmp_path / "calls", "a") as f:
                f.write("".join("x" for _ in texts))
            return super().embed(texts)

    files = spark.createDataFrame([(f"/d/{i}.txt", str(i), bytearray(f"text {i}".encode())) for i in range(3)], "path string, checksum string, content binary")
    store = Collection(spark, str(tmp_path / "s"), buckets=2)
    ingest(files, store, Counting(8))
    assert len((tmp_path / "calls").read_text()) == 3 and store.rows().count() == 3

    class Failing(HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("model lost")

    changed = files.selectExpr("path", "concat(checksum, 'b') AS checksum", "content")
    with pytest.raises(Exception, match="model lost"):
        ingest(changed, store, Failing(8))
    assert left_open(store).count() == 3 and {r.checksum for r in store.rows().collect()} == {"0", "1", "2"}
    ingest(changed, store, Counting(8))
    assert left_open(store).count() == 0 and {r.checksum for r in store.rows().collect()} == {"0b", "1b", "2b"}


def test_stream_and_logs(spark, tree, tmp_path):
    store = Collection(spark, str(tmp_path / "store"), buckets=4)
    for _ in range(2):
        stream(spark, str(tree), store, HashEmbedder(8), str(tmp_path / "state"), "*.txt").awaitTermination()
        assert store.rows().count() == 1
    for k in range(2):
        log_interaction(spark, str(tmp_path / "log"), f"q{k}", "a", f"2024-01-0{k + 1}T00:00:00")
    days = day_logs(spark.read.parquet(str(tmp_path / "log"))).orderBy("day").collect()
    assert len(days) == 2 and "**Question:** q0" in days[0].markdown


def test_catalogue_rules(spark):
    rows = spark.createDataFrame([("a.md", "1", "md"), ("a.md", "1", ""), ("B.MD", None, None), (None, "2", None), ("noext", "3", None)], "path string, checksum string, file_type string")
    assert {x.file_type: x.n for x in catalog.type_counts(rows).collect()} == {"md": 2, "MD": 1, "unknown": 1, "noext": 1}
    assert {x.file_type: x.n for x in catalog.type_counts_shown(rows).collect()} == {"md": 3, "-": 2}
    assert catalog.document_count(rows).first().n_documents == 4 and catalog.by_glob(rows, "*").count() == 4
    tags = spark.createDataFrame([(" A, b ,,a",), (None,), ("C",)], "tags string")
    assert [x.tag for x in catalog.distinct_tags(tags).collect()] == ["a", "b", "c"]
    meta = spark.createDataFrame([("1", {"tags": "Foo,bar", "x": "zzz"}), ("2", {"x": "a FOO b"}), ("3", {"tags": "foobar"}), (None, {"x": "foo"})], "id string, metadata map<string,string>")
    assert [x.id for x in catalog.metadata_search(meta, " foo ").collect()] == ["1", "2"]
    assert catalog.normalised_patterns(["*.md", "a/../b.txt"], "/r") == ["*.md", "/r/b.txt"]


def test_models_and_config(tmp_path, monkeypatch):
    now, waits = [0.0], []
    table = Timetable(1.0, 2, 10, lambda: now[0], lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    for number in (0, 3, 1):
        table.await_turn(number)
    assert waits == [1.0, 15.0]  # the third is late already
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise RateLimited("later", endpoint="e", retry_after=1.5 if len(tries) == 2 else None)
        return [[1.0]]

    waits.clear()
    assert patiently(call, waits.append) == [[1.0]] and waits == [10.0, 1.5, 40.0]
    assert prompt("q", "c", "s").startswith("s\n\n") and prompt("q", "c").endswith("Question: q\n\nContext:c")
    (tmp_path / "c.yaml").write_text("SECURITY:\n  KEY: ${SOME_KEY}\nQUERY:\n  TOP_K: 7\n")
    monkeypatch.setenv("SOME_KEY", "v")
    config = Config.load(str(tmp_path / "c.yaml"))
    assert (config.get("SECURITY.KEY"), config.get("QUERY.TOP_K"), config.get("QUERY.TAG_BOOST"), config.get("NO.SUCH", 3)) == ("v", 7, 1.5, 3)
    (tmp_path / "bad.yaml").write_text("a: [")
    for path in ("bad.yaml", "none.yaml"):
        with pytest.raises(ConfigError):
            Config.load(str(tmp_path / path))
