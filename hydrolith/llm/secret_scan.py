"""Secrets in plain text and under layers of encoding, by a worklist of decoded layers."""

from __future__ import annotations

import binascii
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of secrets in their order and their patterns, whose letters are ASCII.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,6};")
#: A run of base64, perhaps wrapped into lines.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\t\x20]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[\t\x20]*[A-Za-z0-9+/_-]+)?={0,2}")
WRAP = re.compile(r"[\r\n\t\x20]+")
#: No secret is shorter, and only unpacking makes a text longer, so a shorter piece of text can't hold one.
SHORTEST = 14
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}" % SHORTEST)
WIDE = {"utf-16-le": re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}" % SHORTEST), "utf-16-be": re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){%d,}" % SHORTEST)}
#: How compressed data begins: gzip, and zlib at its usual levels.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Bytes of an unpacked layer that are looked at together, and those that the next piece repeats.
PIECE, OVERLAP = 1 << 24, 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in a text as it is, by start and kind; kind counts KINDS."""
    found = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the span of the document that each of its characters comes from; None: the document itself."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, z: int) -> tuple[int, int]:
        return (a, z) if self.start is None else (int(self.start[a]), int(self.end[a:z].max()))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            n = np.arange(len(self.text))
            return n, n + 1
        return self.start, self.end


def _unescape(run: str) -> list[tuple[str, int, int]]:
    """Characters of an escaped run, each with the part of the run that it comes from."""
    if run.startswith("\\u") and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                out.append((chr(0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00), 6 * i, 6 * i + 12))
                i += 2
            else:
                out.append((chr(units[i]) if not 0xD800 <= units[i] < 0xE000 else "�", 6 * i, 6 * i + 6))
                i += 1
        return out
    if run[0] == "&":
        plain = html.unescape(run)
    else:
        code = int(run.strip("\\uUx{}"), 16)
        plain = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    return [(c, 0, len(run)) for c in plain]


def _unquote(run: str) -> list[tuple[str, int, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    out, at = [], 0
    for c in raw.decode("utf-8", "replace"):
        n = len(c.encode()) if c != "�" or raw[at : at + 3] == b"\xef\xbf\xbd" else 1
        out.append((c, 3 * at, min(3 * (at + n), len(run))))
        at = min(at + n, len(raw) - 1)
    return out


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of a pattern decoded where it stands; None if nothing changes."""
    pieces, starts, ends, at = [], [], [], 0
    first, last = layer.edges()
    for m in pattern.finditer(layer.text):
        chars = decode(m[0])
        if "".join(c for c, *_ in chars) == m[0]:
            continue
        pieces += [layer.text[at : m.start()], *(c for c, *_ in chars)]
        starts += [first[at : m.start()], first[[m.start() + a for _, a, _ in chars]] if chars else first[:0]]
        ends += [last[at : m.start()], last[[m.start() + z - 1 for *_, z in chars]] if chars else last[:0]]
        at = m.end()
    if not pieces:
        return None
    return Layer("".join([*pieces, layer.text[at:]]), np.concatenate([*starts, first[at:]]), np.concatenate([*ends, last[at:]]))


def _unpacked(raw: bytes, at: int) -> Iterator[bytes]:
    """What is packed in raw from ``at`` on, members of it one after the other, in pieces that overlap; none if it isn't."""
    left, held = memoryview(raw)[at:].tobytes(), b""
    while left:
        packer = zlib.decompressobj(31 if left[:1] == b"\x1f" else 15)
        try:
            while not packer.eof:
                out = packer.decompress(left, PIECE)
                left = packer.unconsumed_tail
                held += out
                if len(held) >= PIECE:
                    yield held
                    held = held[-OVERLAP:]
                if not out and not left:
                    break
        except zlib.error:
            break
        left = packer.unused_data if packer.eof and PACKED.match(packer.unused_data) else b""
    if held:
        yield held


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Readable pieces of raw, with the first and the last byte of each character."""
    for m in READABLE.finditer(raw):
        text = m[0].decode("utf-8", "replace")
        sizes = np.ones(len(text), np.int64) if text.isascii() else np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
        last = m.start() + np.cumsum(sizes) - 1
        yield text, last - sizes + 1, last
    if b"\x00" in raw:
        for name, pattern in WIDE.items():
            for m in pattern.finditer(raw):
                first = m.start() + 2 * np.arange(len(m[0]) // 2)
                yield m[0].decode(name), first, first + 1


def _inside(raw: bytes, depth: int = 0) -> Iterator[str]:
    """Readable texts in what is packed anywhere in raw, packed again or not."""
    for m in PACKED.finditer(raw):
        for piece in _unpacked(raw, m.start()):
            if piece == raw:
                continue  # it unpacks to itself
            yield from (text for text, *_ in _texts(piece))
            if depth < 64:
                yield from _inside(piece, depth + 1)


def _decoded(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (new := _rewritten(layer, PERCENT, _unquote)):
        yield new
    if ("\\" in text or "&" in text) and (new := _rewritten(layer, ESCAPE, _unescape)):
        yield new
    for m in BASE64.finditer(text):
        run, place = m[0].rstrip("="), np.arange(m.start(), m.end())
        if "\n" in run:
            gaps = np.zeros(len(run), bool)
            for gap in WRAP.finditer(run):
                gaps[gap.start() : gap.end()] = True
            run, place = WRAP.sub("", run), place[: len(run)][~gaps]
        run = run.replace("-", "+").replace("_", "/")
        for phase in range(4):  # what stands before, a path perhaps, may shift the groups of four
            part = run[phase:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            if len(part) < 16:
                continue
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            for plain, first, last in _texts(raw):
                # byte i comes from characters 4i/3 and the next of the run
                start, end = place[phase + first * 4 // 3], place[np.minimum(phase + last * 4 // 3 + 1, len(place) - 1)]
                if layer.start is None:
                    yield Layer(plain, start, end + 1)
                else:
                    yield Layer(plain, layer.start[start], layer.end[end])
            whole = None
            for plain in _inside(raw):
                whole = whole or layer.span(m.start(), m.end())
                yield Layer(plain, np.full(len(plain), whole[0]), np.full(len(plain), whole[1]))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of a text's plain secrets, and of all with those under encodings, by start and kind.

    Layers wait in a worklist; each is searched and decoded (percent signs; Unicode and character references;
    base64 in each phase, wrapped or not, and what is packed in it, all members), and what comes out waits in turn,
    until nothing new comes. A layer that was seen for the same part of the document isn't taken up again, so layers
    that lead back to themselves end. Decoding is lazy and goes deep first, and unpacked layers come in pieces of
    PIECE bytes that overlap by OVERLAP, so a piece a level is held, however much there is to unpack. An encoding
    within an unpacked layer that is longer than the overlap may be read in two parts.
    """
    text = text or ""
    base = base_spans(text)
    every = set(base)
    work, seen = [_decoded(Layer(text))], set()
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        mark = hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), int(new.start[0]), int(new.end.max())
        if mark in seen:
            continue
        seen.add(mark)
        for a, kind, z in base_spans(new.text):
            start, end = new.span(a, z)
            every.add((start, kind, end))
        work.append(_decoded(new))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """The secrets of each row of docs (doc_id, text): doc_id, base and all, arrays of (kind, start, end).

    Offsets count code points, ends are exclusive. One row for each row, without a shuffle; a text is looked at
    whole, and a null one is empty and holds none. Repeated rows and null doc_ids are kept. Other columns are not
    looked at. An empty table gives an empty result.
    """
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": z} for a, k, z in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([rows(f[i]) for f in found], pa.list_(entry)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "every"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {spans}, every {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what secrets() found."""

    def line(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("every").alias("spans"))
