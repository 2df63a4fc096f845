"""Packing, held against encoding each text whole and cutting the stream that the pieces tell."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexiforge.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def plain(text, end=0):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def check(docs, sequences, length):
    """Pieces tile each sequence and each document; ids are those of the whole text; only the last sequence is short."""
    own = sorted(sequences.collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in own] == list(range(len(own)))
    assert all(r.n_tokens == length for r in own[:-1])
    found = {}
    for r in own:
        ids, at = np.frombuffer(bytes(r.ids), "<u4"), 0
        for p in r.pieces:
            assert p.offset == at and p.length > 0
            found.setdefault(p.doc_id, []).append((r.sequence_id, p.offset, p.start, p.doc_tokens, ids[at : at + p.length].tolist()))
            at += p.length
        assert at == r.n_tokens == len(ids)
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        expected.setdefault(r.doc_id, []).append(plain(r.text))
    assert found.keys() == expected.keys()
    for k, texts in expected.items():
        made, now = [], []
        for _, _, start, n, ids in sorted(found[k], key=lambda x: x[:2]):  # in the stream's order
            assert start == len(now)
            now += ids
            if len(now) == n:
                made.append(now)
                now = []
        assert not now and sorted(made) == sorted(texts)


@pytest.mark.parametrize("length", [7, 64, 1024])
def test_odd_rows(spark, length):
    docs = cases.frame(spark).repartition(5)
    check(docs, packing.pack(docs, PATH, length), length)


def test_documents_whole(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    check(docs, packing.pack(docs.repartition(7), PATH), 1024)


def test_windows_over_many_tasks(spark):
    rows = [(i, "a b" if i % 3 else None, "en", "s", 0) for i in range(200)]
    docs = cases.frame(spark, rows).repartition(50)
    check(docs, packing.pack(docs, PATH, 256), 256)


def test_empty(spark):
    assert packing.pack(cases.empty(spark), PATH).count() == 0
    assert packing.pieces_of(packing.pack(cases.empty(spark), PATH)).count() == 0


def test_runs_are_cut_where_the_tokenizer_cuts():
    texts = [
        "a  b\n\n c\t d", "  lead", "trail  \n", "it's we'll 'tis '\ts", "a\xa0 b \xa0  c", "x\u3000\u3000 y", "a\x1c b", "\x85  q", "<|endoftext|> x",
        "1 2  33,44 ...  !!\r\n\r\n--", "\u00e9 \U0001f600  \U0001f600 \u00f1\n", "", " ", "\n", "a\x00 b", "\u200b  z", "\ufeff a",
    ]
    e = packing.Encoder(PATH)
    for _ in range(2):
        for x in texts:
            assert np.frombuffer(e(x), e.dtype).tolist() == plain(x)[:-1], x


def test_padding_and_checksums(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id long, text string")
    made = packing.pack(docs, PATH, 16).cache()
    row = packing.padded(made).first()
    assert len(row.ids) == 4 * (row.n_tokens if bin(row.n_tokens).count("1") == 1 else 16)
    for r in packing.pieces_of(made).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(plain("one two three four five" if r.doc_id == 1 else None), "<u4"))


class Counted:
    """A tokenizer, or its model, that counts the calls that encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.calls = tokenizer, self, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.tokenizer.encode(*args, **kwargs)

    def tokenize(self, text):
        self.calls += 1
        return self.tokenizer.model.tokenize(text)


def test_a_spelling_is_encoded_once_whatever_mark_follows():
    words = [f"{a}{b}\u00e9{c}" for a in "abcdefgh" for b in "ijklm" for c in "nopqr"]
    text = "".join(f" {w}{mark}" for mark in ["", ",", ".", "!", "?", ";", ")"] for w in words)
    e = packing.Encoder(PATH)
    e.whole = e.model = counted = Counted(e.whole)
    assert np.frombuffer(e(text), e.dtype).tolist() == plain(text)[:-1]
    assert counted.calls <= len(words) + 6  # and each mark


ODD = [*" \n\t\r\x0b\x0cabZs1'.,#_(", "  ", "'s", "'re", "'ll", "'S", "\u00e9", "\u00d7", "\u00f7", "\u00c0", "\u00b2", "\u00bd", "\u00aa", "\u00b5", "\u00ad", "\u00a1",
       "\u0133", "\u017f", "\u0180", "\u0300", "\u2014", "\u2019", "\u20ac", "\u4e2d", "\u0436", "\u0664", "\u2167", "\U0001f600", "\x00", "\x7f", "\u200b", "\ufeff",
       "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "<|endoftext|>", "<|"]


@pytest.mark.parametrize(("known", "lookup", "memo", "longest"), [(True, 1 << 21, 800_000, 48), (True, 5, 40, 3), (False, 7, 10, 4)])
def test_slices_of_texts(monkeypatch, known, lookup, memo, longest):
    """Against whole texts, whatever the cuts, with room in the memo or without, and as a slice of an array."""
    for k, v in {"LOOKUP": lookup, "MEMO": memo, "LONGEST": longest}.items():
        monkeypatch.setattr(packing, k, v)
    deal = random.Random(5)
    rare = [x for x in ODD if x in "\x1c\x85\xa0\u2003\u2028\u3000" or x == "<|endoftext|>"]
    common = [x for x in ODD if x not in rare]
    texts = ["".join(deal.choices(ODD if i % 4 == 0 else common, k=deal.randrange(14))) for i in range(2000)]
    e = packing.Encoder(PATH)
    e.known = e.known and known
    array = pa.array(["skipped \u00e9", *texts], pa.string())
    for first, n in [(1, 1), (2, 700), (702, 1299)]:
        ids, counts = e.batch(array.slice(first, n))
        own = texts[first - 1 : first - 1 + n]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(x)[:-1] for x in own]
    assert len(e.memo) <= memo and all(len(x) <= longest for x in e.memo)


def test_a_batch_of_several_slices(spark):
    texts = ["caf\u00e9, it's 12 o'clock.\n" * 20_000, "", "a  b " * 90_000]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "doc_id long, text string").coalesce(1)
    assert sum(len(texts[i % 3].encode()) for i in range(60)) > 2 * packing.SLICE
    rows, before = packing.encoded(docs, PATH).orderBy("doc_id").collect(), 0
    expected = [np.array(plain(x), "<u2").tobytes() for x in texts]
    for i, r in enumerate(rows):
        assert (r.doc_id, r.before, r.n, bytes(r.ids), r.wide) == (i, before, len(expected[i % 3]) // 2, expected[i % 3], False)
        before += r.n
    assert len(rows) == 60
