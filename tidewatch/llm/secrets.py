"""Secret scans: a worklist that unwraps nested encodings and rescans each layer.

Every text is layer 0. Percent escapes, Unicode escapes, base64 runs and
compressed payloads (in base64 or in escapes) in a layer make further layers until none is new, whatever
characters they hold (UTF-8, else Latin-1, and UTF-16 if there are NULs); a layer
that was seen before (same content at the same place) is not entered again, so
self-reproducing payloads end. Every layer carries, for each of its characters,
the span of the original text that it came from, so a hit in any depth is
reported at the original text's code points.

Defined results: a null text counts as empty and has no spans; an empty text has
none; repeated rows give repeated results; other columns are ignored and may
have any name; very long texts are scanned whole; an empty table gives no rows. A
base64 run of fewer than 16 characters isn't decoded: it holds 11 bytes at most,
and no kind of secret is that short. A payload that would decompress beyond ``max_layer_bytes`` is not
expanded in memory: its place is counted in ``n_unscanned``.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import join_spans, map_rows, sha256, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 16 or more is what remains of maximal runs that are shorter or not.
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
#: A run of 16 or more, or runs that a line break and indentation part.
BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=\r?\n[ \t]*+[A-Za-z0-9+/_-]))"
    r"(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}"
)
#: Not base64 but line breaks, indentation and padding.
BETWEEN = b"\r\n\t ="
IN_BODY = ~np.isin(np.arange(256), list(BETWEEN))
URLSAFE = bytes.maketrans(b"+/", b"-_")
#: A run on one line of joined ones.
LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: How gzip, zlib (without a dictionary), bzip2 and xz begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: Compressed bytes that are inflated at once.
CHUNK = 1 << 16

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """The spans of one layer: leftmost, non-overlapping for each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and where its characters lie in the original; no arrays: at the same places."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each escape run replaced by its text."""
    parts, starts, ends, at = [], [], [], 0
    n = len(layer.text)
    own_s = layer.starts if layer.starts is not None else np.arange(n)
    own_e = layer.ends if layer.ends is not None else np.arange(1, n + 1)
    for m in pattern.finditer(layer.text):
        pieces = decode(m[0])
        if pieces is None:
            continue
        parts.append(layer.text[at : m.start()])
        starts.append(own_s[at : m.start()])
        ends.append(own_e[at : m.start()])
        for char, a, b in pieces:
            parts.append(char)
            starts.append(own_s[m.start() + a : m.start() + a + 1])
            ends.append(own_e[m.start() + b - 1 : m.start() + b])
        at = m.end()
    if not at:
        return None
    parts.append(layer.text[at:])
    starts.append(own_s[at:])
    ends.append(own_e[at:])
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        out.append((c, 3 * at, 3 * (at + size)))
        at += size
    return out


def _escape(run: str) -> list[tuple[str, int, int]] | None:
    units, out = [], []
    for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", run):
        units.append((int(m[1] or m[2], 16), m.start(), m.end()))
    i = 0
    while i < len(units):
        code, a, b = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, b = 0x10000 + ((code - 0xD800) << 10) + (units[i + 1][0] - 0xDC00), units[i + 1][2]
            i += 1
        out.append(("�" if 0xD800 <= code < 0xE000 else chr(code), a, b))
        i += 1
    return out


class TooLarge(Exception):
    pass


def _inflate(raw: bytes, at: int, limit: int) -> tuple[bytes, int]:
    """What the compressed payload at a magic number holds, and where it ends; nothing if it is none."""
    if raw[at] in b"\x1f\x78":
        decoder = zlib.decompressobj(47)
    else:
        decoder = bz2.BZ2Decompressor() if raw[at] == 0x42 else lzma.LZMADecompressor()
    out, size, end = [], 0, at
    try:
        while end < len(raw) and not decoder.eof:
            out.append(decoder.decompress(raw[end : end + CHUNK], limit + 1 - size))
            end, size = min(end + CHUNK, len(raw)), size + len(out[-1])
            if size > limit:
                raise TooLarge
        end -= len(decoder.unused_data)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        end = at + 1  # what came before the error stays
    return b"".join(out), end


def _unpacked(raw: bytes, limit: int) -> tuple[list[bytes], int]:
    """All that compressed payloads in raw hold, at any depth, and how many were too large."""
    out, seen, work, skipped = [], {raw}, [raw], 0

    def add(less: bytes) -> None:
        if less and less not in seen:
            seen.add(less)
            out.append(less)
            work.append(less)

    while work:
        packed, at = work.pop(), 0
        members: list[bytes] = []  # payloads that follow each other directly
        while m := MAGIC.search(packed, at):
            if members and m.start() > at:
                add(b"".join(members))
                members = []
            try:
                less, at = _inflate(packed, m.start(), limit - sum(map(len, members)))
            except TooLarge:
                skipped += 1
                at = m.start() + 1
                continue
            members.append(less)
            add(less)
        add(b"".join(members))
    return out, skipped


def _texts(raw: bytes) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """raw as text, and the first and last byte of each character: UTF-8, else Latin-1; with a NUL, UTF-16 too."""
    at = np.arange(len(raw))
    try:
        text = raw.decode()
        first = at if len(text) == len(raw) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text, first = raw.decode("latin-1"), at
    out = [(text, first, np.append(first[1:], len(raw)) - 1)]
    for a in (0, 1) if b"\0" in raw or raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ():
        for code in ("utf-16-le", "utf-16-be"):
            text = raw[a : a + (len(raw) - a) // 2 * 2].decode(code, "replace")
            wide = np.fromiter((2 if c > "\uffff" else 1 for c in text), np.int64, len(text))
            last = a + 2 * np.cumsum(wide) - 1
            out.append((text, last - 2 * wide + 1, last))
    return out


#: What spells a byte in escapes.
BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2})+")


def _escaped(layer: Layer, limit: int) -> tuple[list[Layer], int]:
    """Layers of compressed bytes that are written as escapes, and payloads that were too large."""
    out, skipped = [], 0
    for m in BYTES.finditer(layer.text):
        raw = bytes.fromhex(re.sub(r"%|\\x|\\u00", "", m[0]))
        if not MAGIC.search(raw):
            continue
        packed, over = _unpacked(raw, limit)
        skipped += over
        a, b = layer.place(m.start(), m.end())
        for text in (t for p in packed for t, _, _ in _texts(p)):
            if _matters(text):
                out.append(Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text))))
    return out, skipped


def _matters(text: str) -> bool:
    """Whether a text has spans or may have layers."""
    return "%" in text or "\\" in text or BASE64.search(text) is not None or bool(scan(text))


def _decoded(layer: Layer, start: int, end: int, limit: int) -> tuple[list[Layer], int, int]:
    """Layers of a base64 run in all four phases, how many more have nothing in them, payloads that were too large."""
    out, bare, skipped = [], 0, 0
    run = layer.text[start:end].encode()
    body = run.translate(URLSAFE, BETWEEN)
    if len(body) < 16:
        return out, bare, skipped
    at = start + np.flatnonzero(IN_BODY[np.frombuffer(run, np.uint8)])
    for phase in range(4):
        n = len(body) - phase
        part = body[phase : phase + n - (n % 4 == 1)]
        raw = base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))
        for text, first, last in _texts(raw):
            if not _matters(text):
                bare += 1
                continue
            s = at[phase + 4 * (first // 3) + first % 3]
            e = at[phase + 4 * (last // 3) + last % 3 + 1] + 1
            if layer.starts is not None:
                s, e = layer.starts[s], layer.ends[e - 1]
            out.append(Layer(text, s, e))
        packed, over = _unpacked(raw, limit)
        skipped += over
        for text in (t for p in packed for t, _, _ in _texts(p)):
            if not _matters(text):
                bare += 1
                continue
            a, b = layer.place(start, end)
            out.append(Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text))))
    return out, bare, skipped


def _base64(layer: Layer, limit: int) -> tuple[list[Layer], int, int]:
    """_decoded of all runs: joined over line breaks, and each long line of these by itself."""
    out, bare, skipped = [], 0, 0
    for m in BASE64.finditer(layer.text):
        made, empty, over = _decoded(layer, m.start(), m.end(), limit)
        out += made
        bare += empty
        skipped += over
        if "\n" in m[0]:
            for line in LINE.finditer(layer.text, m.start(), m.end()):
                made, empty, _ = _decoded(layer, line.start(), line.end(), limit)
                out += made
                bare += empty
    return out, bare, skipped


def find(text: str | None, max_layer_bytes: int = 64 << 20) -> dict:
    """base: spans of the text itself; spans: with those of every decoded layer."""
    text = text or ""
    base = scan(text)
    spans, work, seen = set(base), [Layer(text)], {(text, 0, len(text))}
    layers = skipped = 0
    while work:
        layer = work.pop()
        layers += 1
        if layer.starts is not None:
            for a, b, kind in scan(layer.text):
                spans.add((*layer.place(a, b), kind))
        new = []
        if "%" in layer.text:
            new.append(_rewritten(layer, PERCENT, _percent))
        if "\\" in layer.text:
            new.append(_rewritten(layer, ESCAPE, _escape))
        made, bare, over = _base64(layer, max_layer_bytes)
        if "%" in layer.text or "\\" in layer.text:
            more, above = _escaped(layer, max_layer_bytes)
            made, over = made + more, over + above
        layers += bare
        skipped += over
        for child in [*new, *made]:
            if child is None or not child.text:
                continue
            key = (child.text, *child.place(0, len(child.text)))
            if key not in seen:
                seen.add(key)
                work.append(child)
    return {"base": base, "spans": spans, "n_layers": layers, "n_unscanned": skipped}


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_layers long, n_unscanned long"
)


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = 64 << 20
) -> DataFrame:
    """Per row: counts of base spans by kind, their digest, all spans, layers entered."""

    def make():
        def row(doc_id, text):
            found = find(text, max_layer_bytes)
            base = found["base"]
            n = [sum(k == kind for _, _, k in base) for kind in KINDS]
            return (
                doc_id, *n, sha256(join_spans(base, KINDS)), join_spans(found["spans"], KINDS),
                found["n_layers"], found["n_unscanned"],
            )

        return row

    return map_rows(df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text"), make, SCHEMA)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
