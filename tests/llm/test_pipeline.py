import hashlib
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexiforge.llm import decontam, mixing, rules, sharding
from tests.llm import cases
from tests.llm.test_mixing import want_targets
from tests.llm.test_rules import brute as counts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([()])


def groups(rows, least):
    """Groups of rows whose counts of 5-word shingles reach a cosine of `least`, by doc_id."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    norm = {i: sum(n * n for n in s.values()) for i, s in sets.items()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a].keys().isdisjoint(sets[b]):
                continue
            if sum(n * sets[b][g] for g, n in sets[a].items()) >= least * (norm[a] * norm[b]) ** 0.5:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage got and what it returned, on sf0.001."""
    docs, out = spark.read.parquet(f"{cases.SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        into, docs = docs, stage(spark, docs, cases.SF)
        out.append((name, into, docs.collect(), docs.columns))
        docs = spark.createDataFrame(out[-1][2], docs.schema)
    return {name: (into.collect(), got, columns) for name, into, got, columns in out}


def test_stages_keep_the_columns_of_documents(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]
    for name, (into, got, columns) in staged.items():
        assert columns[:5] == COLUMNS and (name == "shard" or len(columns) == 5)
        assert {r[:5] for r in got} <= {r[:5] for r in into}  # rows go or repeat, none changes


def test_quality_rules_against_brute_force(spark, staged):
    into, got, _ = staged["quality_rules"]
    kept = Counter(r.doc_id for r in got)
    for r in into:
        if counts_of(r.text)[5]:
            assert not kept[r.doc_id]
    belief = {r.doc_id: r.posterior for r in rules.judge(spark.createDataFrame(into, cases.SCHEMA)).collect()}
    assert kept == Counter(r.doc_id for r in into if not counts_of(r.text)[5] and belief[r.doc_id] >= 0.5)


def test_near_dedup_against_brute_force(staged):
    """One row stays of each group of rows linked at a cosine of 0.8, the one of the smallest id, and no other goes."""
    into, got, _ = staged["near_dedup"]
    assert sorted(r.doc_id for r in got) == sorted(set(groups(into, 0.8).values()))


def test_decontamination_against_brute_force(spark, staged):
    into, got, _ = staged["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]

    def plain(t):
        return decontam.normalised([t])[0].astype("<u4").tobytes().decode("utf-32-le")

    kept = {r.doc_id for r in got}
    for r in into:
        text = plain(r.text)
        if any(plain(t) in text for t in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:  # an edited passage: the plain distance confirms it
            assert any(decontam.infix_distance(plain(t).strip(), text) <= decontam.MOST * len(plain(t).strip()) for t in items)


def test_mix_against_brute_force(staged):
    into, got, _ = staged["mix_sources"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in into}
    sizes, took, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in into:
        sizes[r.source] += size[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    for r in got:
        took[r.source] += size[r.doc_id]
    for s, want in want_targets(sizes).items():
        assert abs(took[s] - want) <= 0.5 * longest[s] + 1e-6
    assert max(Counter(r.doc_id for r in got).values()) <= mixing.MOST


def test_shards_against_brute_force(staged):
    into, got, columns = staged["shard"]
    assert columns[5:] == ["shard", "depth", "shard_bytes", "shard_docs"]
    assert Counter(r[:5] for r in got) == Counter(into)
    own = defaultdict(int)
    for r in got:
        own[r.shard] += len(r.text.encode())
        bits = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}"
        assert bits.startswith(r.shard) and r.depth == len(r.shard)
    assert all(b <= sharding.SHARD_BYTES for b in own.values())
    assert {r.shard: r.shard_bytes for r in got} == own


def test_run_is_the_stages_one_after_another(spark, staged):
    got = corpus_pipeline.run(spark, cases.SF)
    assert got.columns == staged["shard"][2]
    assert Counter(got.collect()) == Counter(staged["shard"][1])


ODD = [
    *cases.ROWS,
    *[(20 + k, cases.prose(300, 50 + k).replace("7 ", "7. ").replace("3 ", ".\n"), None if k % 2 else "en", None if k % 3 else "a", k) for k in range(8)],
    (40, cases.prose(300, 51).replace("7 ", "7. ").replace("3 ", ".\n"), "en", "a", 1),
    (40, cases.prose(300, 51).replace("7 ", "7. ").replace("3 ", ".\n"), "en", "a", 1),
]


def test_stages_take_odd_rows_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = cases.frame(spark, ODD)
        got = stage(spark, docs, cases.SF)
        assert set(docs.columns) <= set(got.columns)
        rows = got.collect()
        assert {r.doc_id for r in rows} <= {r[0] for r in ODD}
        if name in ("decontaminate", "shard"):  # nothing here holds a passage
            assert len(rows) == len(ODD)
        if name == "near_dedup":
            assert sum(r.doc_id in (21, 40) for r in rows) == 1
        assert stage(spark, cases.empty(spark), cases.SF).count() == 0


CONTRACT = {
    "op2_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_rules": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean",
    },
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_returns_its_contract(spark, name):
    got = entry.queries()[name](spark, cases.SF)
    assert CONTRACT[name].items() <= dict(got.dtypes).items()
    want = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id")
    assert Counter(got.select("doc_id").collect()) == Counter(want.collect())
