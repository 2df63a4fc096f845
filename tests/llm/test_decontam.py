import random

from lexiforge.llm import decontam
from tests.llm import cases


def edit(text, rate, rng):
    out = []
    for c in text:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("abcdefgh") if x < 2 * rate / 3 else c)
        if x > 1 - rate / 3:
            out.append(rng.choice("abcdefgh"))
    return "".join(out)


def plain(text):
    return decontam.normalised([text])[0].astype("<u4").tobytes().decode("utf-32-le").strip()


def slow_infix(item, window):
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(window, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_infix_distance_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        window = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) + edit(item, 0.2, rng)
        assert decontam.infix_distance(item, window) == slow_infix(item, window)


def test_recall_and_clean_documents(spark):
    rng = random.Random(1)
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    rows, docs = items.collect(), []
    for rate, base in ((0.0, 0), (0.05, 1000), (0.1, 2000)):
        docs += [(base + r.item_id, f"{cases.prose(80, i)}. {edit(r.text.upper(), rate, rng)} {cases.prose(60, i + 1)}", "en", "a", 1) for i, r in enumerate(rows)]
    docs += [(5000 + i, cases.prose(300, i), "en", "a", 1) for i in range(50)]
    frame = cases.frame(spark, docs)
    hit = {(r.doc_id, r.item_id) for r in decontam.matches(frame, items).collect()}
    for base, least in ((0, 1.0), (1000, 0.97), (2000, 0.9)):
        assert sum((base + r.item_id, r.item_id) in hit for r in rows) >= least * len(rows)
    assert not any(i >= 5000 for i, _ in hit)
    kept = decontam.clean(frame, items)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {i for i, _ in hit}


def test_long_texts_odd_items_and_blocks(spark, monkeypatch):
    item = cases.prose(40, 9)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "  ,, "), (4, "Tiny answer"), (5, item), (5, item)], "item_id long, text string")
    rows = [*cases.ROWS, (50, cases.prose(4000, 4) + " " + item, "en", "a", 1), (51, "the tiny, ANSWER is", "en", "a", 1), (52, "tiny answers", "en", "a", 1)]
    monkeypatch.setattr(decontam, "PIECE", 3000)
    monkeypatch.setattr(decontam, "BLOCK", 100)
    frame = cases.frame(spark, rows)
    assert sorted({(r.doc_id, r.item_id) for r in decontam.matches(frame, items).collect()}) == [(50, 5), (51, 4)]
    assert decontam.clean(frame, items).count() == len(rows) - 2
    assert decontam.clean(frame, items.limit(0)).count() == len(rows)
    assert decontam.matches(cases.empty(spark), items).count() == 0


def test_planted_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")

    def plain(t):
        return decontam.normalised([t])[0].astype("<u4").tobytes().decode("utf-32-le")

    texts = {r.item_id: plain(r.text) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in plain(d.text)}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}


def test_recall_at_the_radius_by_item_length(spark):
    """Copies edited up to the radius, and items cut short: the target recall for each length."""
    rng = random.Random(4)
    rows = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    for size in (40, 60, 81, 110, 10**6):
        items = []
        for r in rows:
            text = plain(r.text)[:size].strip()
            if len(text) >= min(size, 110):
                items.append((r.item_id, text))
        index = decontam.Index(items, decontam.MOST)
        for share in (0.15, 0.2):
            copies = []
            for i, text in items:
                most = int(share * len(text))
                tries = (plain(edit(text, share, rng)) for _ in range(200))
                copies += [(i, e) for e in tries if most - 1 <= decontam.infix_distance(text, e) <= most][:1]
            got = decontam.scan(index, [f"{cases.prose(20, i)} {e} {cases.prose(20, i + 1)}" for i, e in copies])
            known = sum(i in {items[k][0] for k in own} for (i, _), own in zip(copies, got, strict=True))
            print(size, share, len(copies), round(known / len(copies), 3))
            assert len(copies) > 50 and known >= 0.95 * len(copies), (size, share)


def test_lower_bound_is_one(spark):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()[:40]]
    index = decontam.Index(items, decontam.MOST)
    for k, (_, text, most) in enumerate(index.items):
        points, own, _ = decontam.normalised([f"{cases.prose(5, k)} {edit(text, rng.choice((0.1, 0.2, 0.3)), rng)} {cases.prose(5, k)}"])
        start = len(decontam.normalised([cases.prose(5, k)])[0]) // 8 * 8
        window = points[max(0, start - most - 8) : start + len(text) + most + 16].astype("<u4").tobytes().decode("utf-32-le")
        bound = decontam.least_distances(index, own, decontam.np.array([k]), decontam.np.array([start]))[0]
        assert min(bound, most + 1) <= decontam.infix_distance(text, window)


def test_string_ids_of_items(spark):
    items = spark.createDataFrame([("x1", cases.prose(40, 9)), (None, cases.prose(40, 3))], "item_id string, text string")
    docs = cases.frame(spark, [(50, cases.prose(90, 4) + " " + cases.prose(40, 9), "en", "a", 1), (51, cases.prose(40, 3), "en", "a", 1)])
    assert sorted(((r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()), key=str) == [(50, "x1"), (51, None)]


def test_an_idle_worker_drops_its_index(monkeypatch):
    import time
    from types import SimpleNamespace

    monkeypatch.setattr(decontam, "KEPT", 0.2)
    sent = SimpleNamespace(value=("name", [(1, "some benchmark item of more than forty characters in all")], 0.2))
    first = decontam.indexed(sent)
    decontam.rest()
    assert decontam.indexed(sent) is first  # another task came in time
    decontam.rest()
    time.sleep(1)
    assert not decontam._LAST and decontam.indexed(sent) is not first
    decontam._drop()
