"""Extraction by a model, files sent to a model, pictures' vectors, reports, jobs and errors."""

import pytest
from pyspark.sql import functions as F

from lexiforge import errors, jobs
from lexiforge.models import base
from lexiforge.operators import profile, retrieval
from lexiforge.sources.collection import Collection
from lexiforge.sources.walk import scan_tree
from lexiforge.streaming.ingest import ingest


class Saying:
    """Replies with what a text says behind "say:"."""

    def answer(self, prompt, temperature=0.2, max_tokens=512):
        if "fail" in prompt:
            raise RuntimeError("lost")
        return prompt.partition("say:")[2]


def test_extraction(spark):
    texts = ["say:[b, 'a', \"b\", c]", "say:x=1", "fail", "", None, "say:None", "say: c ,d"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")

    def items(mode, allowed=None):
        return [r["items"] for r in base.extracted(df, Saying(), mode, allowed=allowed).orderBy("id").collect()]

    assert items("keywords") == [["b", "a", "c"], [], [], [], [], [], ["c", "d"]] == items("image_tags")
    assert items("tags", ["c", "a", "z"]) == [["a", "c"], [], [], [], [], [], ["c"]]
    assert items("tags", []) == [[]] * 7 == items("tags")
    assert "Allowed: x, y" in base.asked("tags", "q", ["x", "y"])
    with pytest.raises(errors.ValidationError):
        base.asked("poem", "q")


class Remote:
    def __init__(self):
        self.calls = 0

    def upload(self, content, name):
        self.calls += 1
        if name == "busy.png" and self.calls < 3:
            raise errors.RateLimited("later", retry_after=0.0)
        if name == "bad.png":
            raise RuntimeError("no such kind")
        return f"{name}:{len(content)}"

    def generate(self, handle, prompts):
        return "" if handle.startswith("mute") else f"{handle} {'+'.join(prompts)}"


def test_files_for_a_model(spark):
    df = spark.createDataFrame([(f"/d/{n}.png", bytearray(b"abc")) for n in ("a", "bad", "busy", "mute")], "path string, content binary").coalesce(1)
    rows = {r.path.rpartition("/")[2]: r for r in base.about_files(df, Remote(), ["p", "q"]).collect()}
    assert rows["a.png"].reply == "a.png:3 p+q" and rows["busy.png"].reply == "busy.png:3 p+q"
    assert rows["bad.png"].problem == "no such kind" and rows["mute.png"].problem == "empty reply" and rows["mute.png"].reply is None
    with pytest.raises(errors.ValidationError):
        base.about_files(df, Remote(), [])


def test_pictures_are_embedded_by_their_captions(spark):
    df = spark.createDataFrame([("a", "a red cat", None), ("b", None, "no caption")], "path string, text string, problem string")
    made = base.embedded_images(df, base.HashEmbedder(8), max_calls=1000, period=1).collect()
    assert [r.path for r in made] == ["a"] and made[0].embedding == pytest.approx(base.HashEmbedder(8).embed(["a red cat"])[0])


def test_candidates_keep_the_order_of_the_searches(spark):
    df = spark.createDataFrame([("1", {"tags": "a,b", "x": "zed"}), ("2", {"x": "ZED"}), ("3", {"x": "b"}), ("2", {"tags": "b"})], "id string, metadata map<string,string>")
    assert {r.id: r.place for r in retrieval.candidates(df, ["b"], ["zed"]).collect()} == {"1": 0, "2": 0, "3": 0}
    assert {r.id: r.place for r in retrieval.candidates(df, ["a"], ["zed", "b"]).collect()} == {"1": 0, "2": 1, "3": 2}


def test_report(spark):
    df = spark.createDataFrame([(f"f{i:02d}.{'MD' if i % 3 else 'txt'}", "x" * i + "\n\nyy", i) for i in range(1, 13)], "path string, text string, n long")
    said = profile.report(profile.profiled(df, "path", "text", "n"), path="path")
    for part in ("- **Files:** 12", "- .md: 8 files, 48 bytes, 1 to 11", "- .txt: 4 files", "min=1, max=12, mean=6, median=6", "- **Name:** f07.MD", "- **Files:** 10", "p80=", "# Recommended settings", "`chunk_size`: 512"):
        assert part in said, part
    assert "Recommended" in profile.report(profile.profiled(df.limit(0), "path", "text", "n"), path="path")


def test_jobs(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in {"a.txt": "some words", "b.txt": "", "c.PDF": "x", "d.pdf": "y"}.items():
        (docs / name).write_text(text)
    store, model = Collection(spark, str(tmp_path / "s"), buckets=2), base.HashEmbedder(8)
    ingest(scan_tree(spark, str(docs), extensions=["txt"], content=True)[0], store, model)
    extra = store.rows().limit(1).withColumn("path", F.explode(F.array(F.lit("/x/c.PDF"), F.lit("/x/d.pdf")))).withColumn("id", F.col("path"))
    store.append(extra)
    assert {(r.path, r.status) for r in jobs.remove_kind(store).collect()} == {("/x/c.PDF", "removed"), ("/x/d.pdf", "removed")}
    assert [r.path.rpartition("/")[2] for r in jobs.incomplete_files(store).collect()] == ["b.txt"]
    (docs / "b.txt").write_text("words at last")
    assert jobs.reprocess_incomplete(store, model, str(docs)).count() == 0
    assert {r.document for r in store.rows().collect()} == {"some words", "words at last"} and jobs.incomplete_files(store).count() == 0


def test_errors():
    family = [errors.ValidationError, errors.ModelError, errors.RateLimited, errors.StoreUnreachable, errors.DocumentMissing, errors.RemovalError]
    assert all(issubclass(x, errors.CorpusError) for x in family)
    x = errors.RemovalError("m", requires_cleanup=True, document_id="d")
    assert (x.requires_cleanup, x.document_id, str(x)) == (True, "d", "m") and issubclass(errors.RemovalError, errors.CollectionError)


def test_stored_rows_of_texts_whose_signs_cancel_or_that_have_no_words_equal_their_sql(spark, tmp_path):
    import duckdb

    from lexiforge.plans.catalogue import QUERIES, SQL

    texts = ["w3 w18", "w18 w3 w3 w18", "… →", "\xa0", "a", " \t\n", "?!", "", None]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(SQL["stored_rows"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["stored_rows"](spark, str(tmp_path)).collect())) == sorted(want)
