"""SimHash near-dedup: fingerprints of word shingles, compared bit-sliced.

Candidates meet in buckets; inside a bucket the fingerprints' bits are stored as vertical planes (one
64-lane word holds the same bit of 64 fingerprints), distances of many pairs grow together in carry-save
counters, and a block of lanes is abandoned once all its pairs are beyond the radius.

Two ways to buckets:

* `link_radius`: every pair at `radius` = 2 or fewer differing bits of 64. Four blocks of 16 bits; two
  differing bits leave two blocks equal, so six tables of 32-bit keys hold every pair. A key with more than
  `BUCKET` different fingerprints instead sends each of them to the 65 points within one bit of it (two
  fingerprints at two bits or fewer share such a point), which bounds every group by 65.
* `link_similar`: texts met by any of six min-hashes of their 5-word shingles (a pair with a Jaccard similarity
  of 2/3 shares one with a chance of 0.9986, one of 0.8 with 0.99994) whose 256-bit fingerprints are at most `loose`
  bits apart, 2.5 standard deviations more than a cosine of 0.8 makes them differ on average. Inside a bucket, what
  is surely alike (`tight`: 1.5 deviations fewer) is connected by links to a pivot in linear time, and these classes
  by their nearest pairs. A bucket of more than `BLOCK` texts is settled by many tasks (`settle`): each text links to the
  first of `PIVOTS` random ones that it is near to, texts near to several pivots connect these, and the largest
  class of connected pivots needs no more comparison inside it. Texts outside of that class, however many, meet
  all texts of the bucket in a grid of blocks (`grid`). No task holds more than two blocks.

Each edge of `link_similar` is a pair of texts that are alike themselves, and `dedup` keeps it only if the cosine of the
two texts' shingle counts (by 32-bit hashes) reaches the similarity (`verified`). Where an edge fails, its buckets are looked
at again (`parted_links`): every pair of the bucket that is at most `loose` apart and whose texts the edges that hold leave in
different classes is compared by its cosine, so that no link among a bucket's pairs is lost, however many of its edges fail.

Rows: a null text is an empty one. A text without words has fingerprint zero and links like any other; one
with fewer words than a shingle has a single shingle. Null ids are kept, and so are repeated ones. Extra
columns are ignored by `components_of` and kept by `dedup`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.llm._shared import components, saved, sieve, sifted, unused

SEED = 42
#: A bucket with more different fingerprints goes another exact way.
BUCKET = 4096
#: Texts of a bucket that one task compares at most; a larger bucket is dealt in blocks of about this size.
BLOCK = 1024
#: Random texts of a large bucket that all its texts are compared with.
PIVOTS = 12
#: Pairs of each text that are tried beside those of the spanning forest.
SPARE = 3
#: Hashes whose bits are unpacked at once, whatever a text's length.
CHUNK = 1 << 14
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -----------------------------------------------------------------------------------------


def shingle_hashes(raw: bytes, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of UTF-8 text, A-Z lower-cased, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*(words[i:] for i in range(n)), strict=False)
    return np.fromiter((digest(x, SEED) for x in map(b" ".join, grams)), np.uint64, len(words) - n + 1)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of a 64-bit one (k = 0: itself)."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of h."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, words: int = 1, minhashes: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *also, fp array<long> of `words` 64-bit words, same long, keys array<long>, shingles binary) for each row.

    With min-hashes, same is the hash of the normalised words, equal for texts that differ in case A-Z and white space
    alone, and shingles holds 32 bits of each shingle's hash, sorted.
    """
    kept = [F.col("doc_id"), *(F.col(c) for c in also)]
    source = docs.select(*kept, F.col("text").cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", longs), T.StructField("same", T.LongType()), T.StructField("keys", longs), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, same, keys, sets = [], [], [], []
            for raw in batch.column(batch.num_columns - 1):
                raw = raw.as_py() or b""
                h = shingle_hashes(raw, n)
                fps.append(np.array([majority(mixed(h, k)) for k in range(words)], np.uint64).view(np.int64))
                sets.append(np.sort((h >> np.uint64(32)).astype("<u4")).tobytes() if minhashes else b"")
                if minhashes:
                    same.append(xxhash.xxh64_intdigest(b" ".join(raw.lower().split()), 7))
                    keys.append(np.array([mixed(h, 100 + k).min() if len(h) else 0 for k in range(minhashes)], np.uint64).view(np.int64))
                else:
                    same.append(0)
                    keys.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fps, pa.list_(pa.int64())), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


# --- bit-sliced comparison --------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps (lanes, words) as bit planes (64 * words, ceil(lanes / 64)): lane l is bit l % 64 of word l // 64."""
    lanes, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(lanes, words * 8), axis=1, bitorder="little")
    wide = np.zeros((words * 64, -(-lanes // 64) * 64), np.uint8)
    wide[:, :lanes] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """Booleans (queries, lanes): at most `radius` bits differ.

    Counters start at 2**k - 1 - radius, so that a carry out of their k planes means "beyond the radius".
    Two planes at a time enter by a full adder; words whose 64 lanes are all beyond it leave the work.
    """
    k = max(1, radius.bit_length())
    bits, width = planes.shape
    beyond = np.zeros((len(queries), width), np.uint64)
    row, col = (x.ravel() for x in np.indices(beyond.shape))
    over = np.zeros(len(row), np.uint64)
    last = lanes % 64
    if last:
        over[col == width - 1] = FULL << np.uint64(last)
    count = [np.full(len(row), FULL if ((1 << k) - 1 - radius) >> i & 1 else 0, np.uint64) for i in range(k)]
    flips = np.where(np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").T, FULL, np.uint64(0))
    for b in range(0, bits, 2):
        one, two = planes[b][col] ^ flips[b][row], planes[b + 1][col] ^ flips[b + 1][row]
        half = count[0] ^ one
        carry = (count[0] & one) | (half & two)
        count[0] = half ^ two
        for i in range(1, k):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if b % 16 == 14 and b + 2 < bits:
            alive = over != FULL
            if not alive.all():
                dead = ~alive
                beyond[row[dead], col[dead]] = FULL
                row, col, over, count = row[alive], col[alive], over[alive], [x[alive] for x in count]
                if not len(row):
                    break
    beyond[row, col] = over
    return np.unpackbits(beyond.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :lanes] == 0


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _apart(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)


def links(fps: np.ndarray, groups: np.ndarray, tight: int, loose: int, closed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of lanes that link inside their group; groups are runs of equal numbers.

    What is `tight` or less apart is connected by pairs that are that close themselves. Components of these are
    connected by pairs up to `loose`, the nearest first; as such a pair may prove to be no link, each lane has its
    nearest SPARE of them. Closed lanes count as connected before. Linear in what it returns: a spanning forest for
    each group and these, not its pairs.
    """
    sets, out = _Sets(len(fps)), []

    def join(a: int, b: int) -> None:
        if sets.top(a) != sets.top(b):
            sets.join(a, b)
            out.append((a, b))

    if closed is not None and groups[0] == groups[-1]:
        known = np.flatnonzero(closed).tolist()
        for x in known[1:]:
            sets.join(known[0], x)
    rest, far_pairs = np.arange(len(fps)), []
    if groups[0] == groups[-1]:
        while len(rest) > 256:  # those at the pivot are one component; the others meet all of them, then each other
            near = within(fps[rest[:1]], planes_of(fps[rest]), len(rest), tight)[0]
            here, far = rest[near], rest[~near]
            for x in here[1:].tolist():
                join(int(here[0]), x)
            planes = planes_of(fps[here])
            for at in range(0, len(far), 64):
                i, j = np.nonzero(within(fps[far[at : at + 64]], planes, len(here), loose))
                if not len(i):
                    continue
                x, y = far[at + i], here[j]
                d = _apart(fps, x, y)
                first = np.lexsort((d, i))
                first = first[np.flatnonzero(np.diff(i[first], prepend=-1))]  # each one's nearest
                far_pairs.append(np.stack([d[first], x[first], y[first]], axis=1))
            rest = far
            if len(here) < 64:
                break
    planes = planes_of(fps[rest]) if len(rest) else None
    for at in range(0, len(rest), 64):
        i, j = np.nonzero(within(fps[rest[at : at + 64]], planes, len(rest), loose))
        x, y = rest[at + i], rest[j]
        mine = (x < y) & (groups[x] == groups[y])
        far_pairs.append(np.stack([_apart(fps, x[mine], y[mine]), x[mine], y[mine]], axis=1))
    pairs = np.concatenate(far_pairs) if far_pairs else np.empty((0, 3), np.int64)
    spare = [SPARE] * len(fps)
    for d, a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if sets.top(a) != sets.top(b):
            join(a, b)
        elif d > tight and (spare[a] > 0 or spare[b] > 0):
            out.append((a, b))
        else:
            continue
        if d > tight:
            spare[a] -= 1
            spare[b] -= 1
    return out


def bucket_links(rows: DataFrame, tight: int, loose: int) -> DataFrame:
    """Edges (a, b) between nodes of the same key whose fingerprints link, each of them a link itself.

    rows: key long, node long, fp array<long>, open int. Nodes with open = 0 are known to be connected in their key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, node: np.ndarray, fp: np.ndarray, free: np.ndarray) -> pa.RecordBatch:
            out = []
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            at = 0
            for k in range(1, len(cuts)):  # small buckets share a block of lanes, a large one has its own
                if k + 1 < len(cuts) and cuts[k + 1] - cuts[at] <= 256:
                    continue
                lo, hi = cuts[at], cuts[k]
                out += [(node[lo + i], node[lo + j]) for i, j in links(fp[lo:hi], key[lo:hi], tight, loose, free[lo:hi] == 0)]
                at = k
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        key, node, fp, free = np.empty(0, np.int64), np.empty(0, np.int64), None, np.empty(0, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = more if fp is None else np.concatenate([fp, more])
            free = np.concatenate([free, batch.column(3).to_numpy(zero_copy_only=False)])
            done = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if done:
                yield flush(key[:done], node[:done], fp[:done], free[:done])
                key, node, fp, free = key[done:], node[done:], fp[done:], free[done:]
        if len(key):
            yield flush(key, node, fp, free)

    dealt = rows.select("key", "node", "fp", "open").repartition("key").sortWithinPartitions("key", "open", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _met(keyed: DataFrame) -> DataFrame:
    """keyed without its lonely rows, with n, the nodes of its key."""
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return saved(keyed.join(count, "key"), "met")


# --- large buckets ----------------------------------------------------------------------------------------


def _main_classes(masks: DataFrame) -> DataFrame:
    """key, n, main (the bits of the pivots of the largest class), rest (nodes outside of it). masks: key, n, mask, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, rest = [], []
            for own in batch.column(2).to_pylist():
                classes: list[tuple[int, int]] = []
                for mask, c in ((x["mask"], x["c"]) for x in own if x["mask"]):
                    met = [x for x in classes if x[1] & mask]
                    for x in met:
                        c, mask = c + x[0], mask | x[1]
                    classes = [x for x in classes if x not in met] + [(c, mask)]
                most, bits = max(classes, default=(0, 0))
                main.append(bits)
                rest.append(sum(x["c"] for x in own) - most)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(main, pa.int32()), pa.array(rest, pa.int64())], names=["key", "n", "main", "rest"])

    whole = masks.groupBy("key", "n").agg(F.collect_list(F.struct("mask", "c")).alias("own"))  # 2 ** PIVOTS at most
    return whole.mapInArrow(run, "key long, n long, main int, rest long")


def settle(rows: DataFrame, tight: int) -> tuple[DataFrame, DataFrame]:
    """Of large buckets' rows (key, node, fp, n, ...): edges that connect each one's main class, and its rows where any is left.

    The latter have salt (a block), rest (nodes outside of the main class) and open (1: such a node). Pivots are the
    nodes of the lowest hashes, so that buckets with much the same nodes make much the same edges.
    """
    blocks = f"cast(ceil(n / {BLOCK}D) AS int)"
    each = F.explode(F.expr(f"sequence(0, {blocks} - 1)")).alias("salt")
    salted = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(node, 'salt'), {blocks}) AS int)"))
    least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "fp")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = rows.groupBy("key", "n").agg(*least)
    pivots = pivots.select("key", each, F.array_distinct(F.array(*(F.struct(f"p{i}.node", f"p{i}.fp") for i in range(PIVOTS)))).alias("pivots"))
    apart = "aggregate(zip_with(fp, p.fp, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    bits = f"aggregate(transform(pivots, (p, i) -> if({apart} <= {tight}, shiftleft(1, i), 0)), 0, (s, x) -> s | x)"
    near = salted.join(pivots, ["key", "salt"]).select(*salted.columns, F.expr(bits).alias("mask"), F.expr("transform(pivots, p -> p.node)").alias("pivots"))
    near = saved(near.withColumn("pivot", F.expr("if(mask = 0, NULL, pivots[bit_count((mask & -mask) - 1)])")), "near")
    masks = saved(near.groupBy("key", "n", "mask").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("pivots").alias("pivots")), "masks")
    between = masks.select("node", F.explode(F.expr("filter(pivots, (p, i) -> (shiftright(mask, i) & 1) = 1)")).alias("b"))
    edges = near.where("mask <> 0").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(between).where("a <> b")
    main = _main_classes(masks).where("rest > 0").select("key", each, "main", "rest")
    left = near.join(main, ["key", "salt"]).withColumn("open", F.expr("if((mask & main) = 0, 1, 0)"))
    return edges, left.drop("mask", "pivot", "pivots", "main")


def grid(rows: DataFrame) -> DataFrame:
    """key, node, fp, open: settled rows dealt so that each open one meets every other row of its bucket, block by block."""
    here = f"cast(ceil(rest / {BLOCK}D) AS int)"
    there = f"cast(ceil(n / {BLOCK}D) AS int)"
    every = rows.select("key", "node", "fp", "open", F.explode(F.expr(f"sequence(0, {here} - 1)")).alias("i"), F.col("salt").alias("j"))
    mine = F.expr(f"cast(pmod(xxhash64(node, 'open'), {here}) AS int)").alias("i")
    free = rows.where("open = 1").select("key", "node", "fp", "open", mine, F.explode(F.expr(f"sequence(0, {there} - 1)")).alias("j"))
    return every.union(free).select(F.xxhash64("key", "i", "j").alias("key"), "node", "fp", "open")


# --- links ------------------------------------------------------------------------------------------------


def link_radius(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (node long, different ones) at 2 or fewer differing bits."""
    part = [f"(shiftrightunsigned(node, {16 * i}) & 65535)" for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = ", ".join(f"xxhash64({k}, {part[i]}, {part[j]})" for k, (i, j) in enumerate(pairs))
    keyed = fps.select("node", F.array("node").alias("fp"), F.explode(F.expr(f"array({keys})")).alias("key"))
    met = _met(keyed.select("key", "node", "fp"))
    few, many = met.where(F.col("n") <= BUCKET), met.where(F.col("n") > BUCKET)
    ball = many.select("node").distinct().select("node", F.explode(F.expr("concat(array(node), transform(sequence(0, 63), i -> node ^ shiftleft(1L, i)))")).alias("point"))
    near = ball.select(F.col("node").alias("a"), F.col("point").alias("b")).where("a <> b")
    return bucket_links(few.withColumn("open", F.lit(1)), 2, 2).unionByName(near)


def similar_buckets(sigs: DataFrame) -> DataFrame:
    """key, node, fp, n of the min-hashes that several texts have. sigs: node, fp, keys (min-hashes), one row a node."""
    keyed = sigs.select("node", "fp", F.posexplode("keys").alias("pos", "h"))
    return _met(keyed.select(F.expr("xxhash64(pos, h)").alias("key"), "node", "fp"))


def link_similar(sigs: DataFrame, tight: int, loose: int) -> DataFrame:
    """Edges (a, b) of texts whose fingerprints are alike. sigs: node, fp, keys (min-hashes), one row a node."""
    return _link_met(similar_buckets(sigs), tight, loose)


def _link_met(met: DataFrame, tight: int, loose: int) -> DataFrame:
    few, many = met.where(F.col("n") <= BLOCK), met.where(F.col("n") > BLOCK)
    few = few.select("key", "node", "fp", F.lit(1).alias("open"))
    if many.isEmpty():
        return bucket_links(few, tight, loose)
    settled, left = settle(many, tight)
    return bucket_links(few.union(grid(left)), tight, loose).union(settled)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingles, as sorted arrays."""
    return _counted_cosine(np.unique(a, return_counts=True), np.unique(b, return_counts=True))


def _counted_cosine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, m), (y, n) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = (m * n[at])[y[at] == x].sum()
    return float(shared / np.sqrt(float((m * m).sum()) * float((n * n).sum())))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts' shingles reach the cosine. sets: node, shingles (binary), one row a node."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u4") for s in (x, y))
                ok.append(bool(len(x) and len(y) and cosine(x, y) >= similarity))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # joined by shuffles at every size, so that what moves grows with the edges alone
    met = edges.hint("shuffle_merge").join(one.hint("shuffle_merge"), "a").hint("shuffle_merge").join(two.hint("shuffle_merge"), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joining(rows: list[tuple], loose: int, similarity: float) -> list[tuple[int, int]]:
    """Links between classes of one bucket's rows (key, node, class, fp, shingles): all pairs of different classes are tried,
    the nearest of a block first, but those whose classes a link has joined before."""
    node, fp = [r[1] for r in rows], np.array([r[3] for r in rows])
    _, own = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
    sets, planes, out = _Sets(int(own.max()) + 1), planes_of(fp), []
    counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(x: int) -> tuple[np.ndarray, np.ndarray]:
        if x not in counted:
            counted[x] = np.unique(np.frombuffer(rows[x][4].as_buffer(), "<u4"), return_counts=True)
        return counted[x]

    for at in range(0, len(rows), 64):
        i, j = np.nonzero(within(fp[at : at + 64], planes, len(rows), loose))
        i = i + at
        mine = (i < j) & (own[i] != own[j])
        i, j = i[mine], j[mine]
        order = np.argsort(_apart(fp, i, j), kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if sets.top(own[a]) == sets.top(own[b]):
                continue
            x, y = counts(a), counts(b)
            if len(x[0]) and len(y[0]) and _counted_cosine(x, y) >= similarity:
                sets.join(own[a], own[b])
                out.append((node[a], node[b]))
    return out


def parted_links(met: DataFrame, found: DataFrame, good: DataFrame, sets: DataFrame, loose: int, similarity: float) -> DataFrame:
    """Edges (a, b) that, with those of `found` that hold (`good`), connect all that pairs of a bucket link.

    A bucket without a failed edge has lost nothing. In the others, classes by the good edges meet: all texts outside of a
    bucket's largest class meet all its texts, in blocks if it is large. met: `similar_buckets`; sets: node, shingles.
    """
    failed = saved(found.join(good, ["a", "b"], "left_anti"), "failed")
    if failed.isEmpty():
        return good.limit(0)
    at = met.select("key", "node")
    keys = failed.join(at.withColumnRenamed("node", "a"), "a").join(at.withColumnRenamed("node", "b"), ["key", "b"]).select("key").distinct()
    classes = sets.select("node").join(components(good), "node", "left").select("node", F.coalesce("component", "node").alias("class"))
    rows = saved(met.join(keys, "key").select("key", "node", "fp").join(classes, "node"), "parted")
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("main"))
    own = rows.join(sizes.select("key", "n", "main.class", (F.col("n") - F.col("main.c")).alias("rest")).withColumnRenamed("class", "main").where("rest > 0"), "key")
    own = own.withColumn("open", F.expr("cast(class <> main AS int)"))
    few = own.where(F.col("n") <= BLOCK).select("key", "node", "fp", "open")
    many = own.where(F.col("n") > BLOCK).withColumn("salt", F.expr(f"cast(pmod(xxhash64(node, 'salt'), cast(ceil(n / {BLOCK}D) AS int)) AS int)"))
    dealt = few.union(grid(many)).join(rows.select("node", "class").distinct(), "node")
    dealt = dealt.hint("shuffle_merge").join(sets.hint("shuffle_merge"), "node").select("key", "node", "class", "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    fps = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
                    yield from zip(*(batch.column(c).to_pylist() for c in range(3)), fps, batch.column(4), strict=True)

        for _, bucket in groupby(each(), key=itemgetter(0)):
            out = _joining(list(bucket), loose, similarity)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


# --- the operator -----------------------------------------------------------------------------------------


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, node, ...) with component_id, the smallest doc_id of what the edges connect."""
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = least.join(components(edges), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    joined = saved(joined, "least")
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(lowest, "component").select("node", "component_id"), "node")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, 3-word shingles), component_id: links at 2 or fewer bits."""
    rows = saved(fingerprints(docs).select("doc_id", F.col("fp")[0].alias("node")), "fingerprints")
    out = _labelled(rows, link_radius(rows.select("node").distinct()))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """docs less its near copies: of each group, the row with the smallest doc_id stays (null ids last)."""
    bits = 64 * words
    apart = np.arccos(similarity) / np.pi  # the share of bits that differ at this cosine
    loose = int(bits * apart + 2.5 * np.sqrt(bits * apart * (1 - apart)))
    tight = int(bits * apart - 1.5 * np.sqrt(bits * apart * (1 - apart)))
    text_key, row_key = (unused(docs, x) for x in ("text_key", "id_key"))
    keyed = docs.withColumn(text_key, F.xxhash64("text"))
    own = keyed.select("doc_id", F.col(text_key).alias("tkey"), "text")
    rows = saved(fingerprints(own, shingle, words, 6, ("tkey",)).withColumnRenamed("same", "node"), "signatures")
    sigs = rows.groupBy("node").agg(F.min(F.struct("fp", "keys")).alias("s")).select("node", "s.fp", "s.keys")
    met = similar_buckets(sigs)
    found = _link_met(met, tight, loose).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = saved(found.distinct(), "found")
    linked = saved(found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), "linked")
    # the sieve leaves out most texts without a link before shingles move
    near = sifted(rows.select("node", "shingles"), F.xxhash64("node"), sieve(linked.select(F.xxhash64("node").alias("h"))), "near")
    sets = near.where("near").join(linked.hint("shuffle_merge"), "node", "left_semi")
    sets = saved(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    good = saved(verified(found, sets, similarity), "good")
    edges = good.union(parted_links(met, found, good, sets, loose, similarity))
    joined = saved(rows.select("node").distinct().join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "groups")
    stay = rows.select("doc_id", "tkey", "node").join(joined, "node").groupBy("component")
    stay = stay.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("s")).select("s.doc_id", "s.tkey")
    # texts move only where the sieve holds their row: those that go, those that repeat, and few others
    counts = saved(rows.groupBy("doc_id", "tkey").agg(F.count("*").alias("n")), "counts")
    same = stay.distinct().select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"))
    gone = counts.join(same, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t")), "left_anti")
    gone, repeated = saved(gone.select("doc_id", "tkey"), "gone"), counts.where("n > 1").select("doc_id", "tkey")
    pages = sieve(gone.union(repeated).select(F.xxhash64("doc_id", "tkey").alias("h")))
    maybe, go_key = unused(docs, "maybe"), unused(docs, "go_key")
    dealt = sifted(keyed, F.xxhash64("doc_id", text_key), pages, maybe)
    kept = dealt.where(F.col(maybe))
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", text_key])
    go = gone.select(F.col("doc_id").alias(row_key), F.col("tkey").alias(go_key)).hint("shuffle_merge")
    kept = kept.join(go, F.col("doc_id").eqNullSafe(F.col(row_key)) & (F.col(text_key) == F.col(go_key)), "left_anti")
    kept = dealt.where(~F.col(maybe)).unionByName(kept).drop(maybe)
    return kept.drop(text_key)


__all__ = ["components_of", "dedup", "fingerprints", "grid", "link_radius", "link_similar", "parted_links", "settle", "verified"]
