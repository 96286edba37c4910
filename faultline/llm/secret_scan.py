"""Secrets in texts, also below layers of encoding.

The text itself is scanned for three kinds of spans. Then a worklist unwraps
what is encoded in it: percent escapes, Unicode and character-reference escapes,
base64 runs, and gzip, zlib, bzip2 or xz data inside those. Every layer is
scanned in turn and unwrapped again, until nothing new appears. A layer already
seen at the same place (by its digest) is not taken up again, so cycles (data that
unpacks to itself) end. Each character of a layer knows the span of the original
text it came from, and what is found in a layer is reported there.

Escapes are replaced inside the whole layer, so that a secret is found when only
a part of it is escaped. An escape sign that is escaped again and again
(``%252525..``, ``&#38;#38;..``) is one step. A base64 run becomes a layer of its
own; lines of one width that follow each other are one run. A run that is no text
from its first character on is read in all four alignments, as what it holds may
begin anywhere in it. Bytes that are no text stand for characters that end a match
and drop nothing else. UTF-16 is read as such. Packed data may have several
members; it is looked for at the start of what was decoded and, but for zlib,
inside of it. What it unpacks to is read in windows of ``WINDOW`` bytes that
overlap by ``OVERLAP``, so its length has no bound.

Defined cases. A null text is an empty one. Equal spans of one kind are reported
once. Positions are code points, ends exclusive; what packed data holds has the
span of the whole run. Packed data that breaks off or is damaged is read as far as
it goes. In data beyond one window, a match or an inner layer that is longer than
the overlap may be seen in parts. Rows are independent, so repeated rows, ties and
other columns need no rule.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the kinds in order, their patterns and least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]{24,}")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})"
    r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
# Characters that no text has: what they stand for ends a match.
_NO_TEXT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]")
# An escape sign that is escaped once or more before another escape.
_NESTED = re.compile(
    r"%(?:25)+(?=[0-9A-Fa-f]{2})|&(?:#38;|#[xX]26;)+(?=#)|\\(?:u005[cC]|x5[cC])+(?=[uUx])"
)
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00")

# Unpacked bytes that are read together, and how many of them again with the next.
WINDOW = 64 << 20
OVERLAP = 1 << 20

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


class Layer(NamedTuple):
    text: str
    starts: np.ndarray  # of each character's span in the original text
    ends: np.ndarray
    sure: bool = True  # no guess was needed to get here


def scan(text: str) -> list[Span]:
    """The spans in one layer, by start and kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if len(m[2]) >= ASSIGN_LENGTH
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LENGTH
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _replaced(layer: Layer, parts: list[tuple]) -> Layer:
    """``layer`` with each (start, end, decoded, widths) replaced.

    ``widths`` says how many characters each decoded one took.
    """
    texts, starts, ends, at = [], [], [], 0
    for begin, end, decoded, widths in parts:
        texts += [layer.text[at:begin], decoded]
        edges = begin + np.concatenate([[0], np.cumsum(widths)])
        starts += [layer.starts[at:begin], layer.starts[edges[:-1]]]
        ends += [layer.ends[at:begin], layer.ends[edges[1:] - 1]]
        at = end
    texts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends), layer.sure)


def _byte_lengths(text: str) -> np.ndarray:
    """Bytes of each character; an escaped byte is one."""
    codes = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)
    sizes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.where((codes >= 0xD800) & (codes < 0xE000), 1, sizes).astype(np.int64)


def _nested_parts(text: str):
    for m in _NESTED.finditer(text):
        yield m.start(), m.end(), m[0][0], [m.end() - m.start()]


def _percent_parts(text: str):
    for m in _PERCENT.finditer(text):
        decoded = bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape")
        yield m.start(), m.end(), decoded, 3 * _byte_lengths(decoded)


def _escape_parts(text: str):
    units = []
    for m in _ESCAPE.finditer(text):
        code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
        units.append((m.start(), m.end(), code))
    i = 0
    while i < len(units):
        start, end, code = units[i]
        i += 1
        if 0xD800 <= code < 0xDC00 and i < len(units):
            following, stop, low = units[i]
            if following == end and 0xDC00 <= low < 0xE000:
                code, end, i = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00), stop, i + 1
        if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
            continue
        yield start, end, chr(code), [end - start]


def _unpacker(data: bytes):
    """What unpacks ``data``; None if it is not packed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _pieces(data: bytes) -> Iterator[bytes]:
    """What ``data`` unpacks to, member after member, as far as it goes."""
    while (unpack := _unpacker(data)) is not None:
        zipped = not isinstance(unpack, (bz2.BZ2Decompressor, lzma.LZMADecompressor))
        while not unpack.eof:
            try:
                out = unpack.decompress(data, OVERLAP)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                return
            data = unpack.unconsumed_tail if zipped else b""
            if out:
                yield out
            elif not unpack.eof and (not data if zipped else unpack.needs_input):
                if zipped and (rest := unpack.flush()):
                    yield rest
                return
        data = unpack.unused_data


def _windows(data: bytes) -> Iterator[bytes]:
    """What ``data`` unpacks to in overlapping windows."""
    held: list[bytes] = []
    size = fresh = 0
    for piece in _pieces(data):
        held.append(piece)
        size, fresh = size + len(piece), fresh + len(piece)
        if size >= WINDOW:
            whole = b"".join(held)
            yield whole
            held, size, fresh = [whole[-OVERLAP:]], OVERLAP, 0
    if fresh:
        yield b"".join(held)


def _texts(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """``data`` as text, with the bytes of each character; UTF-16 too if it may be."""
    text = data.decode(errors="surrogateescape")
    yield text, _byte_lengths(text)
    sample = data[:4096]
    for name, mark, zeros in (
        ("utf-16-le", b"\xff\xfe", sample[1::2]),
        ("utf-16-be", b"\xfe\xff", sample[0::2]),
    ):
        if data[:2] == mark or zeros.count(0) * 2 > len(zeros):
            wide = data[: len(data) // 2 * 2].decode(name, errors="replace")
            codes = np.frombuffer(wide.encode("utf-32-le", errors="surrogatepass"), np.uint32)
            yield wide, np.where(codes > 0xFFFF, 4, 2)


def _promising(text: str) -> bool:
    """Whether a layer with bytes that are no text is worth keeping."""
    return bool(
        scan(text)
        or _PERCENT.search(text)
        or _ESCAPE.search(text)
        or _BASE64.search(text)
    )


def _runs(text: str) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """Base64 runs: begin, end, their characters without line ends, and the place
    of each. Lines of the first one's width, and one shorter after them, belong to
    the run; its first line is a run as well."""
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0], np.arange(m.start(), m.end())
        width, end = m.end() - m.start(), m.end()
        lines = [(m.start(), m.end())]
        while (following := _NEXT_LINE.match(text, end)) is not None:
            length = following.end(1) - following.start(1)
            if length > width or text[end - 1] == "=":
                break
            lines.append(following.span(1))
            end = following.end()
            if length < width:
                break
        if len(lines) > 1:
            places = np.concatenate([np.arange(*line) for line in lines])
            yield m.start(), end, "".join(text[a:b] for a, b in lines), places


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """A layer for each reading of a base64 run that holds text or packed data."""
    for begin, end, run, places in _runs(layer.text):
        raw = run.rstrip("=").replace("-", "+").replace("_", "/")
        clean = False
        # guesses are not built on guesses: what they hold is read plainly
        for shift in range(4 if layer.sure else 1):
            body = raw[shift:]
            if len(body) % 4 == 1:
                body = body[:-1]
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except binascii.Error:
                continue
            at = places[shift : shift + len(body)]
            for text, sizes in _texts(data):
                whole = not _NO_TEXT.search(text)
                clean |= whole and shift == 0
                plain = whole and shift == 0
                if not text or not (plain or layer.sure and _promising(text)):
                    continue
                after = np.cumsum(sizes)
                starts = layer.starts[at[(after - sizes) * 4 // 3]]
                ends = layer.ends[at[np.minimum((after * 4 + 2) // 3, len(body)) - 1]]
                yield Layer(text, starts, ends, layer.sure and plain)
            inner = [m.start() for m in _PACKED.finditer(data)]
            if _unpacker(data) is not None and 0 not in inner:
                inner.insert(0, 0)
            for offset in inner:
                for window in _windows(data[offset:]):
                    for text, _ in _texts(window):
                        # no character of packed data has a place of its own
                        first = np.full(len(text), layer.starts[begin])
                        last = np.full(len(text), layer.ends[end - 1])
                        clean = True
                        yield Layer(text, first, last, layer.sure and not _NO_TEXT.search(text))
            if clean:
                break


def _packed_layers(layer: Layer) -> Iterator[Layer]:
    """Packed data that was packed again: a layer that is itself packed."""
    if "\udc8b" not in layer.text[:2] and not layer.text.startswith(("BZh", "\udcfd7zXZ", "x")):
        return
    try:
        data = layer.text.encode(errors="surrogateescape")
    except UnicodeEncodeError:
        return
    for window in _windows(data):
        for text, _ in _texts(window):
            first = np.full(len(text), layer.starts[0])
            last = np.full(len(text), layer.ends[-1])
            yield Layer(text, first, last, layer.sure and not _NO_TEXT.search(text))


def _identity(layer: Layer) -> tuple[bytes, int, int]:
    digest = hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest()
    return digest, int(layer.starts[0]), int(layer.ends[-1])


def unwrapped(text: str) -> tuple[list[Span], int]:
    """Spans found below the surface, and how many layers were unwrapped."""
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text)):
        return [], 0
    places = np.arange(len(text) + 1)
    surface = Layer(text, places[:-1], places[1:])
    work, seen = deque([surface]), {_identity(surface)}
    found, n_layers = set(), 0
    while work:
        layer = work.popleft()

        def children(layer: Layer = layer) -> Iterator[Layer]:
            nested = list(_nested_parts(layer.text))
            if nested:
                yield _replaced(layer, nested)
            for parts in () if nested else (_percent_parts, _escape_parts):
                replaced = list(parts(layer.text))
                if replaced:
                    yield _replaced(layer, replaced)
            yield from _base64_layers(layer)
            yield from _packed_layers(layer)

        for child in children():
            if not child.text:
                continue
            identity = _identity(child)
            if identity in seen:
                continue
            seen.add(identity)
            n_layers += 1
            for start, kind, end in scan(child.text):
                found.add((int(child.starts[start]), kind, int(child.ends[end - 1])))
            work.append(child)
    return sorted(found), n_layers


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SECRETS_TYPE = (
    "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string,"
    "n_layers:int>"
)


def find_secrets(text: str) -> tuple:
    base = scan(text)
    deeper, n_layers = unwrapped(text)
    counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
    spans = sorted({*base, *deeper}) if deeper else base
    return (*counts, _listed(base), _listed(spans), n_layers)


def secrets_column(text: Column) -> Column:
    """Counts and spans of the secrets in each text."""

    def find(column: pa.Array) -> pa.Array:
        rows = [find_secrets(t or "") for t in column.to_pylist()]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()]
        names = ["n_assign", "n_access", "n_hex", "base", "spans", "n_layers"]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names)

    return F.arrow_udf(find, SECRETS_TYPE).asNondeterministic()(text)


def secret_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, counts, base_sha256, spans, n_layers) of every row."""
    found = df.select(F.col(key), secrets_column(F.col(text)).alias("_s"))
    return found.select(
        key,
        *[F.col(f"_s.n_{k}") for k in KINDS],
        F.sha2(F.col("_s.base"), 256).alias("base_sha256"),
        "_s.spans",
        "_s.n_layers",
    )
