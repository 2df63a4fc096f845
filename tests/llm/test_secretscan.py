import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

from lexiforge.llm import secretscan as s
from tests.llm import cases


def spans(text):
    return {f"{s.KINDS[k]}:{a}:{b}" for a, k, b in s.added(text)}


def brute(text):
    text, out = text or "", []
    for k, (kind, pattern, least) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end(), kind))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))
    return tuple(sum(x[1] == k for x in out) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def test_base_matches_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text")
    odd = ["PassWord = abcdef", "ſecret=abcdefg", "token=abc token='abcdefgh'", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24, "f" * 23, None, "", "é" * 5 + " api_key: 'abc.def' " + "0" * 30]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], docs.schema))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    for r in s.findings(docs).collect():
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == want[r.doc_id][:2]
        assert set(filter(None, want[r.doc_id][2].split(","))) <= set(r.spans.split(","))


def test_layers_unwrap_and_map_back():
    plain = "password=hunter2hunter2"
    url = urllib.parse.quote(plain, safe="")
    assert f"assign:3:{3 + len(url)}" in spans("ab " + url + " cd")
    blob = base64.b64encode(plain.encode()).decode()
    assert f"assign:2:{2 + len(blob)}" in spans("x " + blob + " y")
    for squeeze in (zlib.compress, gzip.compress):
        twice = base64.b64encode(squeeze(blob.encode())).decode()
        assert f"assign:2:{2 + len(twice)}" in spans("x " + twice)
    esc = "".join(f"\\u{ord(c):04x}" for c in plain)
    assert f"assign:2:{2 + len(esc)}" in spans("; " + esc + ";")
    nested = urllib.parse.quote(urllib.parse.quote(base64.urlsafe_b64encode(esc.encode()).decode(), safe=""), safe="")
    assert f"assign:0:{len(nested)}" in spans(nested)
    assert spans("token = %22abc%20" + "\U0001f600" + "%3D") == set()


def test_cycles_end_and_bad_layers_stay():
    assert spans("%25" * 30) == set()
    assert spans("%FF%FE \\ud800 \\U99999999 " + "A" * 40) == set()


def test_odd_rows(spark):
    assert s.findings(cases.frame(spark)).count() == len(cases.ROWS)
    assert s.findings(cases.empty(spark)).count() == 0


def test_layers_with_odd_characters_are_scanned():
    plain = "password=hunter2hunter2"
    for odd in ("\xa0", "\ufeff", "\u200d", "\0", "\f", "\x1b[0m"):
        for raw in ((odd + " " + plain).encode(), zlib.compress((plain + " " + odd).encode())):
            blob = base64.b64encode(raw).decode()
            assert f"assign:2:{2 + len(blob)}" in spans("x " + blob + " y"), odd
    for raw in (b"\xff " + plain.encode(), plain.encode("utf-16"), plain.encode("utf-16-be")):
        blob = base64.b64encode(raw).decode()
        assert f"assign:2:{2 + len(blob)}" in spans("x " + blob + " y"), raw
    assert spans("%FF%70assword=hunter2hunter2") == {"assign:3:28"}


def test_wrapped_base64_is_joined():
    plain = "some words before it and then the password=hunter2hunter2hunter2 with more after " * 2
    for raw in (plain.encode(), zlib.compress(plain.encode()), gzip.compress(plain.encode())):
        for width, end in ((76, "\n"), (64, "\r\n"), (20, "\n  ")):
            blob = base64.b64encode(raw).decode()
            lines = end.join(blob[i : i + width] for i in range(0, len(blob), width))
            for before, after in (("x: ", "; y"), ("a-line-of-its-own-here\n", "\nNext")):
                got = spans(before + lines + after)
                assert f"assign:{len(before)}:{len(before) + len(lines.rstrip('='))}" in got or f"assign:{len(before)}:{len(before) + len(lines)}" in got, (width, before)


def test_large_and_later_members_are_read(monkeypatch):
    plain = b" password=hunter2hunter2"
    noise = b"nothing to see here, " * (900_000)
    for raw in (zlib.compress(noise + plain), gzip.compress(b"first") + gzip.compress(plain), gzip.compress(noise) + gzip.compress(plain)):
        assert any(x.startswith("assign:2:") for x in spans("x " + base64.b64encode(raw).decode()))
    monkeypatch.setattr(s, "INFLATED", 1 << 13)
    for at in range(8100, 8300, 7):
        nested = base64.b64encode(zlib.compress(plain * 3))
        assert spans("x " + base64.b64encode(zlib.compress(b"ab, " * (at // 4) + b"," * (at % 4) + nested + b" ab," * 3000)).decode())


def test_random_nests_are_unwrapped():
    """Every secret inside random layers over layers, with a path before or lines around it, at its part of the text."""
    import base64
    import gzip
    import random
    import zlib

    rng = random.Random(8)

    def b64(raw):
        return base64.b64encode(raw).decode()

    def wrapped(raw):
        return "\n".join(b64(raw)[i : i + 76] for i in range(0, len(b64(raw)), 76))

    layers = [
        lambda t: b64(t.encode()), lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), lambda t: b64(gzip.compress(t.encode())), lambda t: b64(zlib.compress(t.encode())),
        lambda t: wrapped(gzip.compress(t.encode())), lambda t: wrapped(t.encode()), lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: b64(gzip.compress(b"pad " * 50) + gzip.compress(t.encode())), lambda t: b64(t.encode() + b"\xff\x00\x1b"),
        lambda t: "a/" * rng.randrange(1, 6) + b64(t.encode()), lambda t: "v1/" + b64(zlib.compress(t.encode())),
    ]
    for n in range(300):
        inner = f"note {cases.prose(rng.randrange(2, 30), n)} password = Hidden{n}xyz; the end"
        for _ in range(rng.randrange(1, 4)):
            inner = rng.choice(layers)(inner)
        before = cases.prose(5, n) + rng.choice([" ", ": ", "\n\n"])
        text = f"{before}{inner} {cases.prose(5, n)}"
        found = s.added(text)
        assert any(k == 0 and a >= len(before) and b <= len(before) + len(inner) for a, k, b in found), (n, text)


def test_bzip2_and_xz():
    import bz2
    import lzma

    plain = b"some words and password=hunter2hunter2 with more"
    for packed in (bz2.compress(plain), lzma.compress(plain), bz2.compress(b"x") + bz2.compress(plain), lzma.compress(plain) + b"after"):
        for before in ("x ", "x a/b/c/d/e/"):
            blob = base64.b64encode(packed).decode()
            got = spans(before + blob + " y")
            assert any(x.startswith("assign:") and int(x.split(":")[1]) >= 2 for x in got), (packed[:6], before)
    blob = base64.urlsafe_b64encode(lzma.compress(plain)).decode()
    assert spans("x " + blob + " y")


def test_a_long_run_takes_time_in_proportion():
    import random
    import time

    rng, took = random.Random(4), []
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for size in (1 << 20, 1 << 22):
        run = "".join(rng.choices(symbols, k=size))
        inside = base64.b64encode(zlib.compress(b"password=hunter2hunter2 and some words")).decode()
        at = time.process_time()
        found = s.added("x " + run + inside + " y")
        took.append(time.process_time() - at)
        assert any(a >= size for a, k, _ in found if k == 0)
    assert took[1] < 60 and took[1] < 8 * took[0] + 1


def plain_layers(text):
    """Layers of a text, the plain way: every alignment of each run whole, every place of each inflated."""
    out = set()
    for m in s.BLOB.finditer(text):
        body = m[0].rstrip("=").translate({45: 43, 95: 47})
        for at in range(len(body) - 15):
            part = body[at:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            if at < 4:
                out.add((m.start() + at, m.end(), raw.decode("utf-8", "replace")))
            try:
                out.add((m.start() + at, m.end(), zlib.decompressobj(47).decompress(raw).decode("utf-8", "replace")))
            except zlib.error:
                pass
    return out


def test_added_spans_equal_a_plain_decoder():
    """On texts of one layer, all spans are those that the plain decoder's layers hold."""
    import random

    rng = random.Random(12)
    for n in range(60):
        inner = f"words {'more ' * rng.randrange(5)}token: Abc{n}defgh {rng.randbytes(12).hex() * 2}"
        raw = rng.choice([inner.encode(), zlib.compress(inner.encode()), gzip.compress(inner.encode())])
        text = f"a note {'p/' * rng.randrange(4)}{base64.b64encode(raw).decode()} end"
        expected = {(a, k, b) for a, b, said in plain_layers(text) for _, k, _ in s.scan(said)}
        assert s.added(text) >= expected and {x for x in s.added(text) if x[0] >= 7} == expected | {x for x in s.added(text) if x not in expected and x[1] == 2}, text
