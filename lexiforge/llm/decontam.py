"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are normalised to lower-case letters and digits with one blank between words. The CGK embedding reads a
string by a random walk: step t writes the symbol under the pointer, and a random bit that depends on t and on
that symbol says whether the pointer moves on. Equal strings walk alike, and after an edit two walks fall into
step again soon, so that few edits mean few differing symbols (Hamming distance).

Each word start of a text begins an item-sized window, and each word of an item is an anchor of the window
that holds it: a walk that starts at the k-th word of an item meets the walk that starts at the k-th word of
its copy. So one walk from each word start of a document serves the windows of all items and all their
anchors. A repetition samples some of the first steps of its walks as the key of a hash table; a key whose
first few symbols no item has is abandoned there. Repetitions, each with a random walk and sample of its own,
find a copy if any anchor agrees in any of them. Of what they find, the embeddings' Hamming distance over the next
`AFTER` steps decides: `AGREE` symbols at least must be equal (steps past the item's end count as equal). The rest
is verified: the least edit distance between the item and any part of its window must be at most `MOST` of the
item's length. Before that, a lower bound of it (the sum over the item's pieces of 64 characters) is taken for
many candidates at once.

The target is a recall of `RECALL` at `MOST` edits for the shortest items of each of the `CLASSES`, whose steps,
samples and repetitions are the cheapest tried that reach it on benchmark items with random edits of characters:
see README. An item of fewer than `SHORT`
characters counts only as a whole, word for word; one without words never does.

Items are taken in blocks of `BLOCK` characters at most, which bounds what is broadcast. Long texts are read in
pieces that overlap by two item lengths. A null text is clean. Null and repeated ids stay as they are; extra
columns stay. Empty tables give empty tables, and no items leave all documents.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

MOST = 0.2
SHORT = 40
RECALL = 0.95
#: Least characters of an item, steps, samples, samples of an early key, repetitions.
CLASSES = ((80, 30, 12, 8, 9), (SHORT, 21, 10, 6, 12))
#: Items of LONG characters and more take FEW repetitions.
LONG, FEW = 120, 6
#: Steps after a key's, and how many of their symbols two walks must have in common.
AFTER, AGREE = 36, 11
REACH = max(c[1] for c in CLASSES) + AFTER
BLOCK = 8 << 20
PIECE = 1 << 19
SEED = 5
#: Bits of the table that says which early keys any item has.
TABLE = 22
#: Seconds that a worker keeps an index without using it.
KEPT = 5.0
#: Candidates that are compared at once.
LANES = 1024
ONE, TOP = np.uint64(1), np.uint64(63)


# --- text -------------------------------------------------------------------------------------------------


@cache
def symbols() -> np.ndarray:
    """A symbol of 1 to 31 for each code point that is a letter or digit, 0 for others."""
    own = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalnum():
            own[c] = 1 + c % 31
    return own


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, their symbols, and where each text starts; two blanks stand between texts."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    own = symbols()[points]
    keep = own != 0
    edge = np.zeros(len(points), bool)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    edge[starts] = True
    keep[1:] |= keep[:-1]
    keep |= edge
    at = np.cumsum(keep)[starts] - 1 if len(starts) else starts
    points, own = points[keep], own[keep]
    points = np.where(own == 0, np.uint32(32), points)
    return points, own, at


def word_starts(own: np.ndarray) -> np.ndarray:
    return np.flatnonzero((own[1:] != 0) & (own[:-1] == 0)) + 1


# --- embedding --------------------------------------------------------------------------------------------


@cache
def walks(kind: int) -> list[list[tuple[np.ndarray, int]]]:
    """For each repetition of a class, its walk in strides of three steps: (table, samples taken so far).

    A table says, for the three symbols that lie at the pointer, how far the pointer moves in the stride (lowest two
    bits) and which symbols the stride's samples read (the rest). The last AFTER steps, past the class's own, read
    every symbol: they aren't part of the key.
    """
    _, steps, samples, _, repeats = CLASSES[kind]
    code = np.arange(1 << 15)
    ahead = np.stack([code >> 10, code >> 5 & 31, code & 31])
    out = []
    for r in range(repeats):
        rng = np.random.default_rng([SEED, steps, r])
        moves = rng.integers(0, 2, (steps + AFTER, 32))
        chosen = {*rng.choice(steps, samples, replace=False).tolist(), *range(steps, steps + AFTER)}
        strides, took = [], 0
        for t in range(0, steps + AFTER, 3):
            moved, read = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
            for step in range(t, t + 3):
                symbol = np.choose(moved, ahead)
                if step in chosen:
                    read = read << 5 | symbol
                    took += 1
                moved = moved + moves[step][symbol]
            strides.append((read << 2 | moved, took))
        out.append(strides)
    return out


def triples(own: np.ndarray) -> np.ndarray:
    """The symbols at each place and the two after it, as one number."""
    wide = own.astype(np.int64)
    return wide[:-2] << 10 | wide[1:-1] << 5 | wide[2:]


ODD = np.uint64(0x9E3779B97F4A7C15)


def early_slot(key: np.ndarray) -> np.ndarray:
    return ((key * ODD) >> np.uint64(64 - TABLE)).astype(np.int64)


def keys_of(ahead: np.ndarray, starts: np.ndarray, kind: int, r: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the walks from starts, which starts they are, where the walks ended, and the early keys.

    kind: a number of CLASSES. ahead: `triples`. known: a table of early slots; others are abandoned.
    """
    first = CLASSES[kind][3]
    pos, which = starts.astype(np.int64), np.arange(len(starts))
    key, early, before = np.zeros(len(starts), np.uint64), None, 0
    for table, took in walks(kind)[r][: -AFTER // 3]:
        stride = table.take(ahead.take(pos, mode="clip"))
        pos += stride & 3
        if took > before:
            key = (key ^ (stride >> 2).view(np.uint64)) * ODD
        before = took
        if early is None and took >= first:
            early = key
            if known is not None:
                live = np.flatnonzero(known.take(early_slot(key)))
                pos, which, key, early = pos[live], which[live], key[live], key[live]
    return key, which, pos, early


def read_on(ahead: np.ndarray, pos: np.ndarray, kind: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """What walks that ended their keys at pos read in their strides after that, and where each of these strides ends."""
    reads, ends = np.empty((len(pos), AFTER // 3), np.int64), np.empty((len(pos), AFTER // 3), np.int64)
    for j, (table, _) in enumerate(walks(kind)[r][-AFTER // 3 :]):
        stride = table.take(ahead.take(pos, mode="clip"))
        reads[:, j] = stride >> 2
        pos = pos + (stride & 3)
        ends[:, j] = pos
    return reads, ends


@cache
def equal_symbols() -> np.ndarray:
    """How many of three symbols agree, by the exclusive or of two reads."""
    code = np.arange(1 << 15)
    return ((code & 31) == 0).astype(np.int64) + ((code >> 5 & 31) == 0) + (code >> 10 == 0)


class Index:
    """The hash tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], most: float):
        points, own, at = normalised([t for _, t in items])
        ends = [*at[1:].tolist(), len(points)]
        self.items = []
        for (i, _), lo, hi in zip(items, at.tolist(), ends, strict=True):
            text = points[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "replace").strip()
            self.items.append((i, text, int(most * len(text))))
        self.longest = max((len(t) for _, t, _ in self.items), default=0)
        self.short = [k for k, (_, t, _) in enumerate(self.items) if 0 < len(t) < SHORT]
        padded = np.concatenate([own, np.zeros(REACH + 3, np.uint8)])
        ahead = triples(padded)
        starts = word_starts(padded) if len(own) else np.empty(0, np.int64)
        owner = np.searchsorted(at, starts, side="right") - 1
        size = np.array([len(t) for _, t, _ in self.items], np.int64)
        first = at + 1  # of an item's text
        self.tables = []
        for kind, (least, _, _, _, repeats) in enumerate(CLASSES):
            below = CLASSES[kind - 1][0] if kind else self.longest + 1
            use = (size[owner] >= least) & (size[owner] < below)
            mine, whose = starts[use], owner[use]
            for r in range(repeats if len(mine) else 0):
                if r == FEW:  # a long item has so many anchors that these repetitions find it
                    mine, whose = mine[size[whose] < LONG], whose[size[whose] < LONG]
                key, _, pos, early = keys_of(ahead, mine, kind, r, None)
                inside = pos < (first + size)[whose]
                known = np.zeros(1 << TABLE, bool)
                known[early_slot(early[inside])] = True
                order = np.flatnonzero(inside)[np.argsort(key[inside], kind="stable")]
                reads, stops = read_on(ahead, pos[order], kind, r)
                reads[stops > (first + size)[whose[order], None]] = -1  # past the item's end
                self.tables.append((kind, r, known, key[order], whose[order], (mine - first[whose])[order], reads))
        self.most = np.array([m for _, _, m in self.items], np.int64)
        self.pieces = -(-size // 64)
        self.first_piece = np.cumsum(self.pieces) - self.pieces
        self.offset = np.concatenate([np.arange(0, n, 64) for n in size.tolist()] or [size])
        self.width = np.concatenate([np.minimum(64, n - np.arange(0, n, 64)) for n in size.tolist()] or [size])
        self.equal = np.zeros((len(self.offset), 32), np.uint64)
        for row, (lo, n) in enumerate(zip((np.repeat(first, self.pieces) + self.offset).tolist(), self.width.tolist(), strict=True)):
            self.equal[row] = np.uint64((1 << 64 - n) - 1)
            np.bitwise_or.at(self.equal[row], own[lo : lo + n], ONE << np.arange(64 - n, 64, dtype=np.uint64))


# --- verification -----------------------------------------------------------------------------------------


def infix_distance(item: str, window: str) -> int:
    """The least edit distance between item and any part of window (bit-parallel, one integer for a column)."""
    n = len(item)
    if not n:
        return 0
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in window:
        m = eq.get(c, 0)
        x = (((m & up) + up) ^ up) | m | down
        plus, minus = down | (full & ~(x | up)), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus, minus = (plus << 1) & full, (minus << 1) & full
        y = m | down
        up, down = minus | (full & ~(y | plus)), plus & y
    return best


def piece_distances(index: Index, own: np.ndarray, piece: np.ndarray, start: np.ndarray, slack: int) -> np.ndarray:
    """The least edit distance between each piece and any part of own that begins within slack of its place."""
    out = np.empty(len(piece), np.int64)
    lead = 64 - index.width[piece]  # a piece lies in a word's upper bits, below it are places that match anything
    equal = index.equal.ravel()
    for at in range(0, len(piece), LANES):
        rows = slice(at, at + LANES)
        pos, base = start[rows] - slack - 8 - lead[rows], piece[rows] * 32
        n = len(base)
        up, down = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64)
        score = np.full(n, 64, np.int64)
        best = score.copy()
        x, y, plus, minus = (np.empty(n, np.uint64) for _ in range(4))
        spot, sign = np.empty(n, np.int64), np.empty(n, np.uint64)
        for _ in range(64 + 2 * slack + 24 + int(lead[rows].max(initial=0))):
            np.add(own.take(pos, mode="clip"), base, out=spot)
            m = equal.take(spot)
            pos += 1
            np.bitwise_and(m, up, out=x)
            x += up
            x ^= up
            x |= m
            x |= down
            np.bitwise_or(x, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, x, out=minus)
            score += np.right_shift(plus, TOP, out=sign).view(np.int64)
            score -= np.right_shift(minus, TOP, out=sign).view(np.int64)
            np.minimum(best, score, out=best)
            plus <<= ONE
            minus <<= ONE
            np.bitwise_or(m, down, out=y)
            np.bitwise_or(y, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(plus, y, out=down)
        out[rows] = best
    return out


def least_distances(index: Index, own: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of each candidate (item, where it would start in own).

    The pieces of an item lie apart, so their least distances add up to no more than the item's. A candidate whose
    sum is beyond its item's most is left there.
    """
    out = np.zeros(len(owner), np.int64)
    live = np.argsort(index.most[owner], kind="stable")
    for k in range(int(index.pieces[owner].max(initial=0))):
        live = live[(index.pieces[owner[live]] > k) & (out[live] <= index.most[owner[live]])]
        for at in range(0, len(live), LANES):
            rows = live[at : at + LANES]
            piece, slack = index.first_piece[owner[rows]] + k, int(index.most[owner[rows[-1]]])
            out[rows] += piece_distances(index, own, piece, start[rows] + index.offset[piece], slack)
    return out


def candidates(index: Index, padded: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, where it would start, in steps of 8) of what any repetition finds and the lower bound lets pass."""
    starts, ahead = word_starts(padded), triples(padded)
    met = [np.empty((0, 3), np.int64)]
    for kind, r, known, keys, owner, offset, reads in index.tables:
        if not len(keys) or not len(starts):
            continue
        key, which, pos, _ = keys_of(ahead, starts, kind, r, known)
        lo = np.searchsorted(keys, key, "left")
        same = keys.take(lo, mode="clip") == key
        key, which, lo, pos = key[same], which[same], lo[same], pos[same]
        count = np.searchsorted(keys, key, "right") - lo
        entry = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        from_ = np.repeat(np.arange(len(which)), count)
        mine, theirs = read_on(ahead, pos, kind, r)[0][from_], reads[entry]
        agree = np.where(theirs < 0, 3, equal_symbols()[np.where(theirs < 0, 0, mine ^ theirs)]).sum(axis=1) >= AGREE
        entry, from_ = entry[agree], from_[agree]
        here = starts[which[from_]]
        text = np.searchsorted(at, here, side="right") - 1
        met.append(np.unique(np.stack([text, owner[entry], (here - offset[entry]) // 8 * 8], axis=1), axis=0))
    every = np.unique(np.concatenate(met), axis=0)
    near = least_distances(index, padded, every[:, 1], every[:, 2]) <= index.most[every[:, 1]]
    return [tuple(x) for x in every[near].tolist()]


def found(index: Index, texts: list[str]) -> list[tuple[int, int, int]]:
    """(text, item, edit distance) of each text that holds an item."""
    points, own, at = normalised(texts)
    if not len(points):
        return []
    padded = np.concatenate([own, np.zeros(REACH + 3, np.uint8)])
    out: dict[tuple[int, int], int] = {}
    tried: dict[tuple[int, int], list[int]] = {}
    ends = [*at[1:].tolist(), len(points)]
    for t, k, start in candidates(index, padded, at):
        if (t, k) in out:
            continue
        _, item, most = index.items[k]
        done = tried.setdefault((t, k), [])
        if any(abs(start - x) <= 8 for x in done):
            continue
        done.append(start)
        lo, hi = max(int(at[t]), start - most - 8), min(ends[t], start + len(item) + most + 16)
        distance = infix_distance(item, points[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "replace"))
        if distance <= most:
            out[t, k] = distance
    if index.short:
        machine = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for k in index.short:
            same.setdefault(f" {index.items[k][1]} ", []).append(k)
        for word, ks in same.items():
            machine.add_word(word, ks)
        machine.make_automaton()
        for t, (lo, hi) in enumerate(zip(at.tolist(), ends, strict=True)):
            for _, ks in machine.iter(points[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "replace") + " "):
                out.update({(t, k): 0 for k in ks})
    return [(t, k, d) for (t, k), d in out.items()]


def scan(index: Index, texts: list[str | None]) -> list[dict[int, int]]:
    """For each text, the items that it holds and their distance; long texts in overlapping pieces."""
    out: list[dict[int, int]] = [{} for _ in texts]
    owner, pieces, load = [], [], 0

    def flush() -> None:
        for t, k, d in found(index, pieces):
            mine = out[owner[t]]
            mine[k] = min(d, mine.get(k, d))

    for i, text in enumerate(texts):
        lap = 4 * index.longest + 1024
        for at in range(0, len(text or ""), PIECE):
            piece = text[at : at + PIECE + lap]
            if load + len(piece) > PIECE and pieces:
                flush()
                owner, pieces, load = [], [], 0
            owner.append(i)
            pieces.append(piece)
            load += len(piece)
    flush()
    return out


# --- the operator -----------------------------------------------------------------------------------------


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of at most BLOCK characters, or one item."""
    load, block = 0, []
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if block and load + len(r.text) > BLOCK:
            yield block
            load, block = 0, []
        block.append((r.item_id, r.text))
        load += len(r.text)
    if block:
        yield block


_LAST: dict[str, Index] = {}
_TIMERS: list[threading.Timer] = []


def _drop() -> None:
    _LAST.clear()
    walks.cache_clear()


def rest() -> None:
    """At the end of a task: what its worker keeps for the next one goes after KEPT seconds without any, so that workers
    that go on with other work don't hold an index of some hundred MB besides."""
    timer = threading.Timer(KEPT, _drop)
    timer.daemon = True
    _TIMERS.append(timer)
    timer.start()


def indexed(sent: Broadcast) -> Index:
    """The index of a broadcast block: made once in each worker, which keeps its last one."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    name, block, most = sent.value
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(block, most)
    return _LAST[name]


def matches(docs: DataFrame, items: DataFrame, most: float = MOST) -> DataFrame:
    """doc_id, item_id, distance (characters edited), similarity: a row for each row of docs and item it holds."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in [*source.schema.fields, *items.schema.fields]}
    text_ids = kinds["item_id"] == "string"
    if not text_ids:
        items = items.withColumn("item_id", items["item_id"].cast("long"))
    schema = f"doc_id {kinds['doc_id']}, item_id {'string' if text_ids else 'long'}, distance long, similarity double"
    out = spark.createDataFrame([], schema)
    for block in blocks(items):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block, most))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = indexed(sent)
            for batch in batches:
                rows = [(i, k, d) for i, own in enumerate(scan(index, batch.column(1).to_pylist())) for k, d in sorted(own.items())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([index.items[r[1]][0] for r in rows], pa.string() if text_ids else pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([round(1 - r[2] / len(index.items[r[1]][1]), 6) for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "distance", "similarity"],
                )
            rest()

        out = out.union(source.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, most: float = MOST) -> DataFrame:
    """The rows of docs that hold no item, with docs' columns. Nothing is shuffled."""
    spark = docs.sparkSession
    text = docs.columns.index("text")
    for block in blocks(items):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block, most))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = indexed(sent)
            for batch in batches:
                yield batch.filter(pa.array([not own for own in scan(index, batch.column(text).to_pylist())], pa.bool_()))
            rest()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


