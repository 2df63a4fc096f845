import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiforge.llm import _shared, simhash
from tests.llm import cases


def brute(docs):
    fps = []
    for i, text in docs:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    label = {f: f for _, f in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = list(label)
    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= 2:
                label[top(a)] = top(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(top(f))) for i, f in fps), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    assert rows_of(simhash.components_of(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = cases.frame(spark)
    assert rows_of(simhash.components_of(docs)) == brute([(r[0], r[1]) for r in cases.ROWS])
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 5, 7, None], key=repr)  # 1, 2 and 6 have no words; 3, 3 and 4 are one text
    assert simhash.components_of(cases.empty(spark)).count() == 0
    assert simhash.dedup(cases.empty(spark)).count() == 0


def test_within_is_exact():
    rng = np.random.default_rng(1)
    for words, radius in ((1, 2), (1, 0), (1, 13), (4, 52)):
        base = rng.integers(0, 2**64, (1, words), dtype=np.uint64)
        noise = np.where(rng.random((300, words * 64)) < rng.random((300, 1)) * 0.4, 1, 0).astype(np.uint8)
        fps = base ^ np.packbits(noise, axis=1, bitorder="little").view(np.uint64)
        want = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2) <= radius
        assert (simhash.within(fps, simhash.planes_of(fps), 300, radius) == want).all()


def test_links_in_large_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    near = [int(base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))) for a in range(0, 64, 3) for b in range(a)]
    far = [int(x) for x in rng.integers(0, 2**63, 400, dtype=np.uint64)]
    alone = near + far
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in alone], "node long").distinct()
    sizes = []
    for bucket in (4096, 40):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        from lexiforge.llm._shared import components

        got = components(simhash.link_radius(df))
        real = got.join(df, "node").groupBy("component").count().collect()
        sizes.append(sorted(r["count"] for r in real if r["count"] > 1))
    assert sizes[0] == sizes[1]
    group = np.array(near, np.uint64)[:, None]
    got = simhash.links(group, np.zeros(len(group)), 2, 2)
    sets = simhash._Sets(len(group))
    for i, j in got:
        assert (near[i] ^ near[j]).bit_count() <= 2
        sets.join(i, j)
    assert len({sets.top(i) for i in range(len(group))}) == 1


def test_near_copies_go_and_others_stay(spark):
    words = cases.prose(600, 3).split()
    rows = [(1, " ".join(words), "en", "a", 1)]
    for k in range(2, 8):  # one word in a hundred differs
        rows.append((k, " ".join(w if (i + k) % 100 else f"new{k}x{i}" for i, w in enumerate(words)), "en", "a", 1))
    rows += [(100 + k, " ".join(f"{w}{k}" for w in cases.prose(300, k).split()) + " " + " ".join(words[:60]), "en", "a", 1) for k in range(20)]
    kept = {r.doc_id for r in simhash.dedup(cases.frame(spark, rows)).collect()}
    assert kept == {1, *range(100, 120)}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """All links of a bucket, found by blocks, against union over all pairs."""
    from lexiforge.llm._shared import components

    rng = np.random.default_rng(7)
    spread = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    families = [(260, 0.05), (120, 0.13), (30, 0.1)] + [(3, 0.08)] * 30
    fps = []
    for base, (size, noise) in zip(spread, families, strict=False):
        flips = (rng.random((size, 256)) < noise).astype(np.uint8)
        fps.append(base ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64))
    fps = np.concatenate(fps)
    radius = 52
    near = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2) <= radius
    sets = simhash._Sets(len(fps))
    for a, b in zip(*np.nonzero(near), strict=True):
        sets.join(int(a), int(b))
    want = sorted(sets.top(i) for i in range(len(fps)))
    want = sorted(want.count(t) for t in set(want))
    rows = [(i + 1, [int(x) for x in f.view(np.int64)], [0] * 6) for i, f in enumerate(fps)]
    sigs = spark.createDataFrame(rows, "node long, fp array<long>, keys array<long>")
    for block, pivots, bucket in ((4096, 12, 4096), (64, 12, 4096), (64, 2, 100), (64, 1, 64), (600, 1, 64)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "PIVOTS", pivots)
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = components(simhash.link_similar(sigs, radius, radius)).groupBy("component").count().collect()
        sizes = sorted(r["count"] for r in got if r["count"] > 1)
        assert sizes == [x for x in want if x > 1], (block, pivots, bucket)


def test_many_texts_outside_of_the_main_class_lose_no_link(spark, monkeypatch):
    """A bucket with many more outside texts than a block."""
    from lexiforge.llm._shared import components

    rng = np.random.default_rng(11)
    flips = (rng.random((150, 2, 256)) < 0.07).astype(np.uint8)
    pairs = rng.integers(0, 2**64, (150, 1, 4), dtype=np.uint64) ^ np.packbits(flips, axis=2, bitorder="little").view(np.uint64)
    near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]).sum(axis=1) <= 52
    rows = [(i + 1, [int(x) for x in f.view(np.int64)], [0] * 6) for i, f in enumerate(pairs.reshape(-1, 4))]
    sigs = spark.createDataFrame(rows, "node long, fp array<long>, keys array<long>")
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "BUCKET", 64)
    got = components(simhash.link_similar(sigs, 40, 52)).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got if r["count"] > 1) == [2] * int(near.sum())


def test_pairs_that_link_are_verified_and_few_are_lost(spark):
    """Against brute force over all pairs: no group holds less than the cosine, and of linked pairs hardly any is parted."""
    import random
    from collections import Counter

    rng = random.Random(5)
    docs = []
    for f in range(60):
        words = cases.prose(120 + 20 * (f % 9), 100 + f).split()
        words = [f"{w}f{f}" for w in words]
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07):
            docs.append((len(docs) + 1, " ".join(w if rng.random() >= share else f"z{rng.random()}" for w in words), "en", "a", 1))

    def count(text):
        w = text.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets, top = {d[0]: count(d[1]) for d in docs}, {d[0]: d[0] for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for f in range(60):
        own = [d[0] for d in docs[8 * f : 8 * f + 8]]
        for a in own:
            for b in own:
                dot = sum(n * sets[b][g] for g, n in sets[a].items())
                if a < b and dot >= 0.8 * (sum(n * n for n in sets[a].values()) * sum(n * n for n in sets[b].values())) ** 0.5:
                    top[max(find(a), find(b))] = min(find(a), find(b))
    want = {i for i in sets if find(i) == i}
    got = {r.doc_id for r in simhash.dedup(cases.frame(spark, docs, extra=False)).collect()}
    assert want <= got  # whoever has no link stays
    assert len(sets) - len(got) >= 0.97 * (len(sets) - len(want))


def test_columns_named_like_the_stage_s_own(spark):
    docs = cases.frame(spark, extra=False)
    for c in ("__tkey", "__id", "tkey", "text_key", "id_key", "stay_key", "shingles", "same", "keys"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    got = simhash.dedup(docs)
    assert got.columns == docs.columns and sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 3, 5, 7, None], key=repr)


def test_sieve_holds_all_its_keys_at_any_fill(spark, monkeypatch):
    rows = spark.range(-20000, 60000).selectExpr("id", "xxhash64(id) AS page")
    keys = rows.where("id % 7 = 0").selectExpr("page AS h")
    for bits, most in ((1 << 25, 200), (1 << 16, 20000), (1 << 15, 40000)):
        monkeypatch.setattr(_shared, "SIEVE", bits)
        got = _shared.sifted(rows, F.col("page"), _shared.sieve(keys), "hit")
        assert got.columns == ["id", "page", "hit"] and got.count() == 80000
        assert got.where("id % 7 = 0 AND NOT hit").count() == 0
        assert got.where("id % 7 <> 0 AND hit").count() < most
    none = _shared.sifted(rows, F.col("page"), _shared.sieve(keys.limit(0)), "hit")
    assert none.where("hit").count() == 0


def test_a_full_sieve_changes_no_result(spark, monkeypatch):
    docs = cases.frame(spark).union(cases.frame(spark))
    whole = sorted(map(str, simhash.dedup(docs).collect()))
    monkeypatch.setattr(_shared, "SIEVE", 1)
    assert sorted(map(str, simhash.dedup(docs).collect())) == whole


@pytest.mark.parametrize("block", [1024, 8])
def test_no_link_is_lost_where_edges_fail(spark, monkeypatch, block):
    """Families near the limit, most of whose edges fail: the rows that stay are those of union over all pairs of the buckets."""
    import random

    texts = []
    for seed in (4, 14, 17, 34):
        rng = random.Random(seed)
        base = [f"w{rng.random()}" for _ in range(150)]
        texts += [" ".join(w if rng.random() >= 0.027 else f"z{rng.random()}" for w in base) for _ in range(14)]
    sigs = []
    for x in texts:
        h = simhash.shingle_hashes(x.encode(), 5)
        fp = np.array([simhash.majority(simhash.mixed(h, k)) for k in range(4)], np.uint64)
        sigs.append((fp, [simhash.mixed(h, 100 + k).min() for k in range(6)], np.sort((h >> np.uint64(32)).astype("<u4"))))
    sets = simhash._Sets(len(texts))
    for a, (fp, keys, shingles) in enumerate(sigs):
        for b in range(a):
            met = any(x == y for x, y in zip(keys, sigs[b][1], strict=True)) and np.bitwise_count(fp ^ sigs[b][0]).sum() <= 68
            if met and simhash.cosine(shingles, sigs[b][2]) >= 0.8:
                sets.join(a, b)
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = cases.frame(spark, [(i, x, "en", "a", 1) for i, x in enumerate(texts)], extra=False)
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == {i for i in range(len(texts)) if sets.top(i) == i}
