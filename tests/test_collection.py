"""Writers beside each other, transactions, retention and views of the stored collection."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexiforge.errors import CollectionError
from lexiforge.models.base import HashEmbedder
from lexiforge.operators import catalog
from lexiforge.sources import collection as c
from lexiforge.sources.collection import Collection, Conflict
from lexiforge.streaming import ingest as i


def rows(spark, paths, text="text", tags="a, B"):
    own = [(f"{p}:{k}", p, f"sum-{p}", f"{text} {k}", tags, [1.0, 0.0], {"k": "v"}) for p in paths for k in range(2)]
    return spark.createDataFrame(own, c.SCHEMA)


def bucket_of(spark, store, path):
    return store._hit(spark.createDataFrame([(path,)], "path string"))[0]


def two_paths(spark, store):
    """Paths of different buckets."""
    paths = [f"p{n}.md" for n in range(20)]
    first = paths[0]
    return first, next(p for p in paths if bucket_of(spark, store, p) != bucket_of(spark, store, first))


def racing(store, other, act):
    """act() of `store`, with other() done after its rows are written and before its commit, once."""
    done, commit = [], store._commit

    def late(change):
        if not done:
            done.append(1)
            other()
        return commit(change)

    store._commit = late
    act()
    assert done


def test_writers_of_different_buckets_both_succeed_without_doing_work_twice(spark, tmp_path):
    one, two = Collection(spark, str(tmp_path), buckets=8), Collection(spark, str(tmp_path))
    p, q = two_paths(spark, one)
    made = []
    write = one._write
    one._write = lambda r: made.append(1) or write(r)
    racing(one, lambda: two.append(rows(spark, [q])), lambda: one.append(rows(spark, [p])))
    assert len(made) == 1 and {r.path for r in one.rows().collect()} == {p, q}
    assert one.counts("rows").first().n == 4 and one.counts("documents").first().n == 2


def test_writers_of_one_bucket_are_put_in_order(spark, tmp_path):
    one, two = Collection(spark, str(tmp_path), buckets=1), Collection(spark, str(tmp_path))
    racing(one, lambda: two.append(rows(spark, ["q.md"])), lambda: one.append(rows(spark, ["p.md"])))
    assert {r.path for r in one.rows().collect()} == {"p.md", "q.md"}
    racing(one, lambda: two.append(rows(spark, ["p.md"], "theirs")), lambda: one.append(rows(spark, ["p.md"], "mine")))
    assert {r.document for r in one.rows().where("path = 'p.md'").collect()} == {"mine 0", "mine 1"}
    racing(one, lambda: two.append(rows(spark, ["r.md"])), lambda: one.delete(ids=["q.md:0"]))
    racing(one, lambda: two.append(rows(spark, ["s.md"])), lambda: one.append(rows(spark, ["r.md"], "more"), replace_paths=False))
    assert one.counts("rows").first().n == one.rows().count() == 2 + 1 + 4 + 2
    assert one.counts("documents").first().n == 4


def test_a_change_that_always_meets_another_ends_in_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "TRIES", 2)
    store = Collection(spark, str(tmp_path), buckets=1)

    def late(change):
        raise Conflict("again")

    monkeypatch.setattr(store, "_commit", late)
    with pytest.raises(CollectionError, match="kept changing"):
        store.append(rows(spark, ["p"]))


def test_threads_that_write_at_once(spark, tmp_path):
    Collection(spark, str(tmp_path), buckets=4)
    failed = []

    def work(n):
        try:
            own = Collection(spark, str(tmp_path))
            own.append(rows(spark, [f"t{n}-{k}.md" for k in range(3)]))
            own.delete(ids=[f"t{n}-0.md:0"])
        except Exception as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed
    store = Collection(spark, str(tmp_path))
    assert store.rows().count() == 3 * 5 == store.counts("rows").first().n


def test_no_state_takes_the_place_of_another(spark, tmp_path):
    store = Collection(spark, str(tmp_path), buckets=1)
    state = store._state()
    assert store._publish(state | {"number": 7}) and not store._publish(state | {"number": 7, "metric": "l2"})
    assert store._state()["metric"] == "cosine" and not list((tmp_path / "corpus").glob("aside-*"))


def test_retention(spark, tmp_path):
    store = Collection(spark, str(tmp_path), buckets=1, retention=3600)
    folder = tmp_path / "corpus"
    (folder / "rows-being-written").mkdir()  # another writer's, that no state names yet
    reader = store.rows()
    for k in range(4):
        store.append(rows(spark, ["p.md"], f"v{k}"))
    assert reader.count() == 0 and (folder / "rows-being-written").exists() and len(store._states()) == 5
    live = {p.split("/")[0] for own in store._state()["parts"].values() for p in own}
    long_ago = time.time() - 7200
    for x in folder.iterdir():
        os.utime(x, (long_ago, long_ago))
    store.append(rows(spark, ["q.md"], "new"))
    left = {x.name for x in folder.iterdir() if x.name.startswith("rows-")}
    assert "rows-being-written" not in left and live <= left and len(store._states()) == c.KEPT
    assert {r.document for r in store.rows().collect()} == {"v3 0", "v3 1", "new 0", "new 1"}


def test_a_change_whose_rows_are_gone_is_refused(spark, tmp_path):
    store = Collection(spark, str(tmp_path), buckets=1)
    with pytest.raises(CollectionError, match="gone"):
        store._commit(c.Change(1, added={"0": ["rows-none/bucket=0"]}))


def test_views_equal_what_is_counted_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "VIEW_PARTS", 3)
    rng, store = random.Random(4), Collection(spark, str(tmp_path), buckets=4)
    for step in range(9):
        paths = [f"d{rng.randrange(8)}.{rng.choice(['md', 'txt'])}" for _ in range(3)]
        own = rows(spark, sorted(set(paths)), f"s{step}", rng.choice(["x, Y", "y", "", "z,x,x"]))
        if rng.random() < 0.3:
            own = own.withColumn("checksum", F.lit(f"c{step}"))
        what = rng.randrange(4)
        if what < 2:
            store.append(own, replace_paths=bool(what))
        elif what == 2:
            store.delete(ids=[r.id for r in store.rows().collect() if rng.random() < 0.4] or ["none"])
        else:
            store.remove(["d1*", "*.none"])
        now = store.rows()
        assert {r.key: r.n for r in store.counts("types").collect()} == {r.file_type: r.n for r in catalog.type_counts(catalog.unique_documents(now)).collect()}
        assert sum(r.n for r in store.counts("documents").collect()) == catalog.document_count(now).first().n_documents
        assert sum(r.n for r in store.counts("rows").collect()) == now.count()
        assert store.tags() == [r.tag for r in catalog.distinct_tags(now).collect()]
        assert len(store._state()["views"]) <= c.VIEW_PARTS + 1


def test_a_transaction_is_made_once(spark, tmp_path):
    store = Collection(spark, str(tmp_path), buckets=2)
    store.append(rows(spark, ["p"], "first"), txn=("app", 3))
    before = store._state()
    store.append(rows(spark, ["p"], "again"), txn=("app", 3))
    store.append(rows(spark, ["p"], "before"), txn=("app", 2))
    assert store._state() == before and store.done("app", 3) and not store.done("app", 4) and not store.done("other", 0)
    other = Collection(spark, str(tmp_path))
    racing(store, lambda: other.append(rows(spark, ["q"], "theirs"), txn=("app", 4)), lambda: store.append(rows(spark, ["r"], "mine"), txn=("app", 4)))
    assert {r.path for r in store.rows().collect()} == {"p", "q"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("one text")
    store, model, state = Collection(spark, str(tmp_path / "s"), buckets=2), HashEmbedder(8), str(tmp_path / "state")
    real = i.ingest

    def killed(*args, **options):
        real(*args, **options)
        raise OSError("killed between the rows' commit and the checkpoint's")

    monkeypatch.setattr(i, "ingest", killed)
    with pytest.raises(Exception, match="killed"):
        i.stream(spark, str(docs), store, model, state, "*.txt").awaitTermination()
    after = store._state()
    assert store.rows().count() == 1 and len(after["txns"]) == 1
    monkeypatch.setattr(i, "ingest", real)
    # what a second run would store, had it not the batch's number
    store.delete(ids=[r.id for r in store.rows().collect()])
    emptied = store._state()
    i.stream(spark, str(docs), store, model, state, "*.txt").awaitTermination()
    assert store._state() == emptied and store.rows().count() == 0
    (docs / "b.txt").write_text("another text")
    i.stream(spark, str(docs), store, model, state, "*.txt").awaitTermination()
    assert [r.path.rpartition("/")[2] for r in store.rows().collect()] == ["b.txt"]
    assert list(store._state()["txns"]) == [json.loads((tmp_path / "state" / "metadata").read_text())["id"]]


def test_marks_of_other_runs_stay(spark, tmp_path):
    store = Collection(spark, str(tmp_path), buckets=2)
    mine = spark.createDataFrame([("/d/a.txt", "1", bytearray(b"text a"))], "path string, checksum string, content binary")
    spark.createDataFrame([("/d/z.txt", "9")], i.MARKS).write.parquet(f"{store.folder}/open/theirs")
    spark.createDataFrame([("/d/a.txt", "1")], i.MARKS).write.parquet(f"{store.folder}/open/lost")
    i.ingest(mine, store, HashEmbedder(8))
    assert [r.path for r in i.left_open(store).collect()] == ["/d/z.txt"] and store.rows().count() == 1


def test_an_append_writes_documents_once_and_repeated_ids_are_still_settled(spark, tmp_path):
    rng = random.Random(4)
    texts = [f"{rng.getrandbits(8 * 4000):x}" for _ in range(60)]
    rows = [(f"i{i}", f"p{i}", "c", x, "t", [0.0], {}) for i, x in enumerate(texts)]
    store = Collection(spark, str(tmp_path / "s"), buckets=4)
    assert store.append(spark.createDataFrame(rows, c.SCHEMA)).count() == 0
    on_disk = sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))
    assert on_disk < 1.2 * sum(map(len, texts))  # it was written as it came, and then to its buckets
    again = [("i1", "p1", "c", "b", "t", [0.0], {}), ("i1", "other", "c", "a", "t", [0.0], {}), ("i2", "p2", "c", "new", "t", [0.0], {})]
    assert [tuple(r) for r in store.append(spark.createDataFrame(again, c.SCHEMA)).collect()] == [("i1", 2)]
    got = {r.id: (r.path, r.document) for r in store.rows().collect()}
    assert got == {f"i{i}": (f"p{i}", x) for i, x in enumerate(texts)} | {"i1": ("other", "a"), "i2": ("p2", "new")}
    assert store.rows().count() == 60 and store.counts("rows").first().n == 60


def test_many_small_appends_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexiforge.sources.collection.CROWD", 3)
    store = Collection(spark, str(tmp_path / "s"), buckets=1)
    for i in range(6):
        store.append(spark.createDataFrame([(f"i{i}", f"p{i}", "c", "x", "t", [0.0], {})], c.SCHEMA))
    assert store.rows().count() == 6 and len(store.rows().inputFiles()) <= 6
