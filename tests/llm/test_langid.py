from lexiforge.llm import langid
from tests.llm import cases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.n_chars >= 40]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()


def test_prediction_uses_text_alone_and_labels_of_learners_only(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 'xx', lang) AS lang", "'s' AS source")
    a, b = ({(r.doc_id, r.lang_pred) for r in langid.identified(d).collect()} for d in (docs, changed))
    assert a == b


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in langid.identified(cases.frame(spark)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[6].lang_pred == "und" and rows[1].score == 0
    assert langid.identified(cases.frame(spark)).count() == len(cases.ROWS)
    assert langid.identified(cases.empty(spark)).count() == 0
    none = cases.frame(spark).selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    assert {r.lang_pred for r in langid.identified(none).collect()} == {"und"}


def test_pieces_add_up(monkeypatch):
    text = "Ein kurzer Text, aus Wörtern und Zahlen 12 gemacht. " * 3
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert [x.tolist() for x in langid.trigrams(text)] == [x.tolist() for x in whole]


def test_prediction_against_a_plain_computation(spark):
    """Vectors trigram by trigram, from the definition."""
    import zlib
    from collections import Counter

    import numpy as np

    def letters(text):
        out = []
        for c in f" {(text or '').lower()} ":
            c = ord(c) if c.isalpha() else 0
            if c or not out or out[-1]:
                out.append(c)
        return out

    def vector(text):
        s, out = letters(text), np.zeros(langid.DIM)
        for t, n in Counter(zip(s, s[1:], s[2:], strict=False)).items():
            if t[1]:
                a, b, c = (langid.letter_vector(x).astype(float) for x in t)
                out += n * np.roll(a, 2) * np.roll(b, 1) * c
        size = np.linalg.norm(out)
        return out / size if size else out

    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 400) AS text", "lang")
    more = [(10**6 + i, t, lang) for i, (t, lang) in enumerate([("один два три", "ru"), ("два один сто", "ru"), ("ένα δύο τρία", "el"), ("δύο ένα", "el"), ("три", None)])]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    rows = docs.collect()
    learn = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sums = {x: sum(vector(r.text) for r in learn if r.lang == x) for x in sorted({r.lang for r in learn})}
    names, own = list(sums), np.array([v / np.linalg.norm(v) for v in sums.values()])
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    for r in rows:
        v = vector(r.text)
        cosine = own @ v
        assert got[r.doc_id].lang_pred == (names[int(cosine.argmax())] if v.any() else "und")
        assert abs(got[r.doc_id].score - (max(0, cosine.max()) if v.any() else 0)) < 1e-5
