"""Secret scans with a recursive decoding worklist.

The base layer is the text. A worklist unwraps each layer: URL escapes and Unicode escapes are replaced where
they stand, and runs of base64, also those wrapped over lines of equal length, become layers of their own,
inflated first if they hold zlib, gzip, bzip2 or xz data (not bare deflate, which has no mark); a run is read at all four alignments, as a path or a name may precede
what is encoded. What isn't UTF-8 is replaced, and the rest scanned; bytes with NULs
are read as UTF-16, too. Each new layer is scanned and unwrapped again until nothing new comes; a layer whose content has been seen at the
same place ends there, so a cycle does too. Each layer carries, for each of its characters, the part of the
text that it came from, and what is found is reported at that part.

Kinds: assign, access, hex (see PATTERNS); each is matched leftmost and non-overlapping, and a match whose
secret is too short is dropped. A base span stays, whatever the layers add; an added span that equals one isn't
repeated.

A null text is an empty one. Null and repeated ids stay. Extra columns are ignored; an empty table gives an
empty table. What is inflated is read to its end, member after member, in pieces of about `INFLATED` bytes that
overlap by `LAP`; a piece doesn't end inside a run that could be a layer. Layers are worked depth first.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
#: What a text must hold for each kind, or for any layer; searched over whole columns.
SIGNS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
LAYERS = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]{2}|[A-Za-z0-9+/_-]{16}"
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A layer without any of these holds neither a secret nor a layer.
WORTH = re.compile("|".join(f"(?:{x.replace('(?i)', '')})" for x in (*SIGNS.values(), LAYERS)), re.IGNORECASE)
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
XZ = b"\xfd7zXZ\0"
#: The first symbols of gzip, zlib, bzip2 and xz data in base64.
PACKED = re.compile(r"H4sI|eAE|eF4|eJ|eN[o-r]|QlpoO|/Td6WFo")
INFLATED, LAP = 1 << 20, 1 << 12
#: The last byte that can't belong to a run, an escape or a line end.
BREAK = re.compile(rb"[^A-Za-z0-9+/_=%\\{}\x00\r\n\t-](?=[A-Za-z0-9+/_=%\\{}\x00\r\n\t-]*\Z)")

Span = tuple[int, int, int]


def scan(text: str, kinds: tuple[str, ...] = KINDS) -> list[Span]:
    """(start, kind number, end) of each match."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind not in kinds:
            continue
        for m in PATTERNS[kind].finditer(text):
            size = len(m[2]) if kind == "assign" else m.end() - m.start()
            if size >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return out


def _opened(raw: bytes):
    """What undoes the compression that raw begins with, if it is a known one."""
    if raw[:2] in MAGIC:
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == XZ else None


def _inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """What the compressed members at the start of blocks hold, as far as they are sound, in parts; then what follows
    them. Blocks are taken as they are needed: data that only looks compressed costs what is read up to its first error."""
    raw, packed = next(blocks, b""), False
    while (stream := _opened(raw)) is not None:
        packed, more = True, raw
        while True:
            try:
                part = stream.decompress(more, INFLATED)
            except (zlib.error, lzma.LZMAError, OSError):
                return
            if part:
                yield part
            if stream.eof:
                break
            more = getattr(stream, "unconsumed_tail", b"") or next(blocks, b"")
            if not (more or part):
                return
        raw = stream.unused_data.lstrip(b"\0")
        while len(raw) < len(XZ) and (more := next(blocks, b"")):
            raw = (raw + more).lstrip(b"\0")
    if packed and raw:
        yield raw
        yield from blocks


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    fresh, goal = 0, INFLATED
    for part in parts:
        held += part
        fresh += len(part)
        if len(held) < goal:
            continue
        cut = BREAK.search(held, max(0, len(held) - INFLATED // 2))
        if cut is None or cut.start() <= LAP:
            goal = 2 * len(held)
            continue
        yield held[: cut.start()]
        held = held[cut.start() - LAP :]
        fresh, goal = len(held) - LAP, INFLATED
    if fresh:
        yield held


def _said(parts: Iterator[bytes]) -> Iterator[str]:
    """What parts may say that is worth a look."""
    for piece in _pieces(parts):
        for code in ("utf-8", "utf-16-le", "utf-16-be") if b"\0" in piece else ("utf-8",):
            text = piece.decode(code, "replace")
            if WORTH.search(text):
                yield text


def _decoded(body: str, at: int, size: int) -> Iterator[bytes]:
    """base64 from a place on, in blocks that grow."""
    while at < len(body):
        part = body[at : at + size]
        part = part[: len(part) - (len(part) % 4 == 1)]
        yield base64.b64decode(part + "=" * (-len(part) % 4))
        at, size = at + size, min(4 * size, 1 << 18)


def _blob(found: str, aligned: int = 1) -> Iterator[tuple[int, str]]:
    """(place in the run, text) of what a run of base64 may say: as it stands, at `aligned` alignments, as a path or a name may
    precede what is encoded, and inflated, from there and wherever a compressed stream's first symbols stand. Bytes
    behind such symbols are read as they stand by the alignments alone."""
    body = found.rstrip("=").translate({45: 43, 95: 47})
    for at in range(min(aligned, max(1, len(body) - 15))):
        yield from ((at, x) for x in _said(_decoded(body, at, len(body) + 4 - len(body) % 4)))
    starts = {*range(aligned)} | ({m.start() for m in PACKED.finditer(body) if len(body) - m.start() >= 16} if aligned > 1 else set())
    for at in sorted(starts):
        yield from ((at, x) for x in _said(_inflated(_decoded(body, at, 1 << 10))))


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of base64 over several lines: lines of equal length, with or without a line before and after."""
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        sizes = [b - a for a, b in lines]
        if max(sizes) < 16:
            continue
        runs, p = {(0, len(lines) - 1)}, 0
        while p < len(lines):
            q = p
            while q + 1 < len(lines) and sizes[q + 1] == sizes[p]:
                q += 1
            runs |= {(max(a, 0), min(b, len(lines) - 1)) for a in (p - 1, p) for b in (q, q + 1) if sizes[p] >= 16}
            p = q + 1
        for a, b in sorted(runs):
            if a < b:
                yield lines[a][0], lines[b][1], "".join(text[i:j] for i, j in lines[a : b + 1])


class Layer:
    """A text, and where each of its characters begins and ends in the document."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray):
        self.text, self.lo, self.hi = text, lo, hi

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with each match's characters decoded; decode gives (character, its width in the match)."""
        text, lo, hi, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            chars = decode(m)
            if chars is None:
                continue
            text.append(self.text[at : m.start()])
            lo.append(self.lo[at : m.start()])
            hi.append(self.hi[at : m.start()])
            pos = m.start()
            for c, width in chars:
                text.append(c)
                lo.append(self.lo[pos : pos + 1])
                hi.append(self.hi[pos + width - 1 : pos + width])
                pos += width
            at = m.end()
        if not at:
            return None
        return Layer("".join(text) + self.text[at:], np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]]))

    def unwrapped(self) -> Iterator[Layer]:
        if "%" in self.text and (x := self.replaced(URL, _url)):
            yield x
        if "\\" in self.text and (x := self.replaced(ESCAPE, _escape)):
            yield x
        runs = ((m.start(), m.end(), m[0], 4) for m in BLOB.finditer(self.text))
        lines = ((*x, 1) for x in _wrapped(self.text)) if "\n" in self.text else ()
        for a, b, run, aligned in chain(runs, lines):
            for at, text in _blob(run, aligned):
                n = len(text)
                yield Layer(text, np.broadcast_to(self.lo[a + at], n), np.broadcast_to(self.hi[b - 1], n))


def _url(m: re.Match) -> list[tuple[str, int]]:
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    return [("\ufffd", 3) if 0xDC80 <= ord(c) <= 0xDCFF else (c, 3 * len(c.encode())) for c in text]


def _escape(m: re.Match) -> list[tuple[str, int]] | None:
    if m[1]:
        units = bytes.fromhex(m[1].replace("\\u", ""))
        text = units.decode("utf-16-be", "surrogatepass")
        return [("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c, 12 if ord(c) > 0xFFFF else 6) for c in text]
    code = int(m[2] or m[3] or m[4], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), len(m[0]))]


def added(text: str) -> set[Span]:
    """What the layers of a text hold."""
    out: set[Span] = set()
    n = np.arange(len(text) + 1)
    work, seen = [Layer(text, n[:-1], n[1:]).unwrapped()], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.lo[0]), int(layer.hi[-1]))
        if key in seen:
            continue
        seen.add(key)
        work.append(layer.unwrapped())
        out |= {(int(layer.lo[a]), k, int(layer.hi[b - 1])) for a, k, b in scan(layer.text)}
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 (of the text itself), spans, n_added."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            has = {k: np.asarray(pc.match_substring_regex(texts, s).fill_null(False)) for k, s in SIGNS.items()}
            wraps = np.asarray(pc.match_substring_regex(texts, LAYERS).fill_null(False))
            counts, sha, spans, more = np.zeros((3, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for i in np.flatnonzero(np.logical_or.reduce([*has.values(), wraps])).tolist():
                text = texts[i].as_py()
                base = scan(text, tuple(k for k in KINDS if has[k][i]))
                for _, k, _ in base:
                    counts[k, i] += 1
                new = added(text) - set(base) if wraps[i] else set()
                more[i] = len(new)
                if base:
                    sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined([*base, *new])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(sha), pa.array(spans), pa.array(more)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    return source.mapInArrow(run, schema)
