"""The stored collection: Parquet under one folder, partitioned by a bucket of the path, so that replacing or
removing documents rewrites the buckets that hold them and no others.

States are numbered files, a log: a change writes its rows, then the next state, aside and renamed into place, so that a
state is whole or isn't there, readers never see half a change, and a crash at any step leaves the state before. A state
says for each bucket which number changed it last. A writer that finds later states than the one it read goes on from
the newest if none of them changed a bucket that it has read; else it makes its change again, up to TRIES times.
Changes of different buckets therefore never fail each other.

A change may carry a transaction, (application, version): a state keeps the last version of each application, and a change
whose version is not later than that has been made already and is left out. That is how a replayed batch changes nothing.

Views (rows, documents, documents by type, rows by tag) are kept with each commit: a change adds the counts of the
buckets that it touched as they are now, less what they were. Reading a view sums those up; many are merged into one.

Folders of rows and counts are removed when no state names them any more and they are older than `retention`; states
when they aren't among the newest KEPT ones and as old. A folder that another writer is filling is younger than that.
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.errors import CollectionError
from lexiforge.functions import text as t
from lexiforge.functions.predicates import where
from lexiforge.operators import catalog, retrieval

SCHEMA = "id string, path string, checksum string, document string, tags string, embedding array<float>, metadata map<string,string>"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
COUNTS = "view string, key string, n long"
BUCKETS = 64
KEPT = 2
#: Tasks that write a bucket, and the files a bucket, on average, from which a change deals them anew.
WRITERS, CROWD = 4, 16
#: Seconds that what no state needs is kept, so that readers and writers of a day's length lose nothing.
RETENTION = 86_400.0
#: How often a change is made anew, and how many tables of counts a view is read from.
TRIES, VIEW_PARTS = 10, 16


class Conflict(CollectionError):
    """Another writer changed what a change was made from."""


@dataclass
class Change:
    """New parts of buckets: those that take the place of all that a bucket had, and those that are added to it."""

    base: int
    replaced: dict[str, list[str]] = field(default_factory=dict)
    added: dict[str, list[str]] = field(default_factory=dict)
    counts: str | None = None
    txn: tuple[str, int] | None = None

    def touched(self) -> set[str]:
        return set(self.replaced) | set(self.added)


class Collection:
    """append, delete and search rows of (id, path, checksum, document, tags, embedding, metadata)."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "corpus", metric: str = "cosine", buckets: int = BUCKETS, retention: float = RETENTION):
        self.spark, self.folder, self.retention = spark, f"{folder.rstrip('/')}/{name}", retention
        state = self._state()
        if state is None:
            if metric not in ("cosine", "l2", "ip"):
                raise CollectionError(f"unknown metric {metric!r}")
            self._publish({"number": 1, "metric": metric, "buckets": buckets, "parts": {}, "changed": {}, "txns": {}, "views": []})
            state = self._state()  # another writer's, if that was first
        self.metric, self.buckets = state["metric"], state["buckets"]

    # --- files --------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _listed(self) -> list[tuple[str, float]]:
        """Names in the folder, and when each was changed last, in seconds."""
        fs, target = self._fs(self.folder)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(target)] if fs.exists(target) else []

    def _states(self) -> list[int]:
        """Numbers of the states, the newest first."""
        found = (re.fullmatch(r"state-(\d+)\.json", name) for name, _ in self._listed())
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _state(self, number: int | None = None) -> dict | None:
        """The state of a number, or the newest one; None if there is none or it can't be read."""
        if number is None:
            return next((x for x in map(self._state, self._states()) if x is not None), None)
        fs, target = self._fs(f"{self.folder}/state-{number:012d}.json")
        try:
            stream = fs.open(target)
        except Exception:  # noqa: BLE001  another writer has removed it, being too old
            return None
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """Puts a state in its place; False if there is one of that number."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, aside = self._fs(f"{self.folder}/aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-{state['number']:012d}.json")
        try:  # neither takes the place of a file: a hard link, and a rename of this kind
            if fs.getUri().getScheme() == "file":
                here, there = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (aside, place))
                jvm.java.nio.file.Files.createLink(there, here)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                context.rename(fs.makeQualified(aside), fs.makeQualified(place), gateway.new_array(rename, 0))
        except Exception:
            if fs.exists(place):
                return False
            raise
        finally:
            fs.delete(aside, False)
        return True

    # --- commits ------------------------------------------------------------------------------------------

    def _changing(self, make: Callable[[dict], Change | None]) -> bool:
        """Makes a change of the newest state and commits it; again, where another writer came between."""
        for turn in range(TRIES):
            change = make(self._state())
            if change is None:
                return False
            try:
                return self._commit(change)
            except Conflict:
                time.sleep(random.uniform(0, 0.05 * 2**turn))
        raise CollectionError("other writers kept changing the same buckets")

    def _commit(self, change: Change) -> bool:
        """Writes the next state; False if the change's transaction has been made before."""
        for path in {p for own in (change.replaced, change.added) for parts in own.values() for p in parts}:
            fs, target = self._fs(f"{self.folder}/{path}")
            if not fs.exists(target):
                raise CollectionError(f"{path} is gone: the change took longer than the retention")
        merged: tuple[list[str], str] | None = None
        while True:
            numbers = self._states()  # once: a state that comes later has the number that this one is to have
            now = next(x for x in map(self._state, numbers) if x is not None)
            if change.txn and now["txns"].get(change.txn[0], -1) >= change.txn[1]:
                return False
            if any(now["changed"].get(b, 0) > change.base for b in change.touched()):
                raise Conflict("another writer changed a bucket that this change was made from")
            parts = now["parts"] | change.replaced
            parts |= {b: [*parts.get(b, []), *own] for b, own in change.added.items()}
            views = [*now["views"], *([change.counts] if change.counts else [])]
            if len(views) > VIEW_PARTS and (merged is None or not set(merged[0]) <= set(views)):
                merged = views, self._merged(views)
            if merged is not None and set(merged[0]) <= set(views):
                views = [merged[1], *(x for x in views if x not in merged[0])]
            number = numbers[0] + 1
            state = now | {"number": number, "parts": parts, "views": views, "changed": now["changed"] | dict.fromkeys(change.touched(), number)}
            if change.txn:
                state["txns"] = now["txns"] | {change.txn[0]: change.txn[1]}
            if self._publish(state):
                self.clean()
                return True

    def done(self, application: str, version: int) -> bool:
        """Whether this transaction, or a later one of the application, has been committed."""
        return self._state()["txns"].get(application, -1) >= version

    def clean(self) -> None:
        """Removes old states, and folders that no state names, both only beyond the retention."""
        listed, whole, used, first = self._listed(), 0, set(), 0
        old = {name for name, changed in listed if time.time() - changed > self.retention}
        for n in self._states():
            state = self._state(n)
            if state is None or (whole >= KEPT and f"state-{n:012d}.json" in old):
                continue
            whole, first = whole + 1, n
            used |= {p.split("/")[0] for own in state["parts"].values() for p in own} | set(state["views"])
        for name, _ in listed:
            number = re.fullmatch(r"state-(\d+)\.json", name)
            unused = name.startswith(("rows-", "counts-", "aside-")) and name not in used
            if name in old and (unused or (number and int(number[1]) < first)):
                fs, target = self._fs(f"{self.folder}/{name}")
                fs.delete(target, True)

    # --- rows ---------------------------------------------------------------------------------------------

    def _read(self, parts: dict[str, list[str]], buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, own in parts.items() if buckets is None or b in buckets for p in own]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def rows(self, buckets: list[str] | None = None) -> DataFrame:
        return self._read(self._state()["parts"], buckets)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("string")

    def _hit(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # `buckets` values at most

    def _write(self, rows: DataFrame, deal: bool = True) -> dict[str, list[str]]:
        """Writes rows; the part of each bucket that has any. Rows that come from few buckets a task, as stored ones do,
        needn't be dealt."""
        name = f"rows-{uuid.uuid4().hex}"
        own = rows.select(*NAMES).withColumn("bucket", self._bucket())
        if deal:
            own = own.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(WRITERS)))
        own.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self._parts(name)

    def _parts(self, name: str) -> dict[str, list[str]]:
        fs, target = self._fs(f"{self.folder}/{name}")
        found = (s.getPath().getName() for s in fs.listStatus(target))
        return {x[7:]: [f"{name}/{x}"] for x in found if x.startswith("bucket=")}

    def _crowded(self, state: dict, buckets: list[str]) -> bool:
        """Whether buckets have so many files, from many small changes, that they are to be dealt into few again."""
        return len(self._read(state["parts"], buckets).inputFiles()) > CROWD * max(1, len(buckets))

    def _paths(self, paths: DataFrame) -> DataFrame:
        """Paths, each once and as a table of their own, whose size tells whether a join can send it to the tasks."""
        name = f"{self.folder}/rows-{uuid.uuid4().hex}"
        paths.select("path").distinct().write.parquet(name)
        return self.spark.read.schema("path string").parquet(name)

    # --- changes ------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, replace_paths: bool | DataFrame = True, txn: tuple[str, int] | None = None) -> DataFrame:
        """Stores rows; returns ids that occur twice or more (the first by chunk text is kept). Rows of the same
        paths, or of the paths given, are replaced in the same commit, unless replace_paths is off. rows are computed
        once: they are written to their buckets first, and all else reads that; only buckets with ids that occur twice are
        written again. With a transaction that was made before, nothing is stored."""
        if txn and self.done(*txn):
            return self.spark.createDataFrame([], "id string, n long")
        added = self._write(rows)
        came = self._read(added)
        repeated = catalog.duplicate_ids(came)
        twice = came.join(repeated.select(F.col("id").alias("twice")), F.col("id").eqNullSafe(F.col("twice")), "left_semi")
        again = self._hit(twice)  # an id's rows may lie in several buckets
        if again:
            here = self._read(added, again)
            once = here.groupBy("id").agg(F.min_by(F.struct(*[c for c in NAMES if c != "id"]), "document").alias("r")).select("id", "r.*")
            added = {b: p for b, p in added.items() if b not in again} | self._write(once)
        paths = self._paths(came if isinstance(replace_paths, bool) else replace_paths)
        hit = self._hit(paths)

        def make(state: dict) -> Change | None:
            if replace_paths is False:
                change = Change(state["number"], added=added, txn=txn)
            else:
                left = self._read(state["parts"], hit).join(paths, "path", "left_anti")
                written = self._write(left, self._crowded(state, hit)) if any(b in state["parts"] for b in hit) else {}
                for b, own in added.items():
                    written[b] = [*written.get(b, []), *own]
                change = Change(state["number"], replaced={b: written.get(b, []) for b in hit if b in state["parts"] or b in written}, txn=txn)
                change.added = {b: p for b, p in written.items() if b not in change.replaced}
            return self._counted(state, change)

        self._changing(make)
        return repeated

    def _remove(self, hits: Callable[[DataFrame], DataFrame], left: Callable[[DataFrame], DataFrame]) -> None:
        def make(state: dict) -> Change | None:
            hit = [b for b in self._hit(hits(self._read(state["parts"]))) if b in state["parts"]]
            if not hit:
                return None
            written = self._write(left(self._read(state["parts"], hit)), self._crowded(state, hit))
            return self._counted(state, Change(state["number"], replaced={b: written.get(b, []) for b in hit}))

        self._changing(make)

    def delete_where(self, paths: DataFrame) -> None:
        """Removes all rows of the paths; buckets without any stay as they are."""
        gone = self._paths(paths)
        self._remove(lambda rows: gone, lambda rows: rows.join(gone, "path", "left_anti"))

    def delete(self, ids: list[str] | None = None, spec: dict | None = None) -> None:
        """By ids, else by filter; one of them is required."""
        if not ids and not spec:
            raise CollectionError("ids or a filter are required")
        gone = F.col("id").isin(ids) if ids else where(spec)
        self._remove(lambda rows: rows.where(gone), lambda rows: rows.where(~F.coalesce(gone, F.lit(False))))

    def remove(self, patterns: list[str], root: str = "/") -> DataFrame:
        """pattern, path, status for each pattern, after removing what they match and looking again."""
        own = catalog.normalised_patterns(patterns, root)
        before = self.rows()
        hits = catalog.removal_matches(before, own).select("path").distinct()
        report_before = before.select("path").distinct()
        self.delete_where(hits)
        return catalog.removal_report(report_before, self.rows(), own)

    def drop(self) -> None:
        fs, target = self._fs(self.folder)
        fs.delete(target, True)

    # --- views --------------------------------------------------------------------------------------------

    def _counted(self, state: dict, change: Change) -> Change:
        """The change with the counts of the buckets that it touches: as they will be, less what they are."""
        parts = state["parts"] | change.replaced
        parts |= {b: [*parts.get(b, []), *own] for b, own in change.added.items()}
        touched = sorted(change.touched())
        columns = ["path", "checksum", "tags"]
        after = self._read(parts, touched).select(*columns, F.lit(1).alias("side"))
        before = self._read(state["parts"], touched).select(*columns, F.lit(-1).alias("side"))
        name = f"counts-{uuid.uuid4().hex}"
        view_counts(after.unionByName(before)).write.parquet(f"{self.folder}/{name}")
        change.counts = name
        return change

    def _merged(self, views: list[str]) -> str:
        name = f"counts-{uuid.uuid4().hex}"
        self._counts(views).write.parquet(f"{self.folder}/{name}")
        return name

    def _counts(self, views: list[str]) -> DataFrame:
        if not views:
            return self.spark.createDataFrame([], COUNTS)
        all_ = self.spark.read.schema(COUNTS).parquet(*(f"{self.folder}/{x}" for x in views))
        return all_.groupBy("view", "key").agg(F.sum("n").alias("n")).where("n <> 0")

    def counts(self, view: str) -> DataFrame:
        """key, n of a view: rows, documents (one key each), types (documents by suffix), tags (rows by tag)."""
        return self._counts(self._state()["views"]).where(F.col("view") == view).select("key", "n")

    # --- reading ------------------------------------------------------------------------------------------

    def has(self, checksum: str) -> bool:
        return not self.rows().where(F.col("checksum") == checksum).limit(1).isEmpty()

    def tags(self) -> list[str]:
        """All tags in order, from the view: no rows are read, and a change of rows changes it."""
        return [r.key for r in self.counts("tags").orderBy("key").collect()]

    def search(self, query: list[float], k: int = 40, spec: dict | None = None) -> DataFrame:
        return retrieval.top_k(self.rows(), query, k, self.metric, spec)


def view_counts(rows: DataFrame) -> DataFrame:
    """view, key, n: what `side` (1 or -1) adds to each view by rows of (path, checksum, tags, side). The rows of a
    side hold whole documents."""
    one = F.lit("").alias("key")
    plain = rows.groupBy(one).agg(F.sum("side").alias("n")).select(F.lit("rows").alias("view"), "key", "n")
    tags = rows.select(F.explode(F.array_distinct(F.transform(t.split_csv(F.col("tags")), F.lower))).alias("key"), "side")
    tags = tags.groupBy("key").agg(F.sum("side").alias("n")).select(F.lit("tags").alias("view"), "key", "n")
    kind = F.coalesce(F.substring_index("path", ".", -1), F.lit("unknown")).alias("key")
    types = rows.select("path", "checksum", "side").distinct().groupBy(kind).agg(F.sum("side").alias("n"))
    both = types.select(F.inline(F.array(F.struct(F.lit("types").alias("view"), "key", "n"), F.struct(F.lit("documents").alias("view"), one, "n"))))
    documents = both.groupBy("view", "key").agg(F.sum("n").alias("n"))
    return plain.unionByName(tags).unionByName(documents).where("n <> 0")
