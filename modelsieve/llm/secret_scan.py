"""Secrets in texts, also in encoded layers, by a recursive decoding worklist.

The text itself is the first layer. Every layer is scanned by the base patterns and searched for
encoded parts, which are decoded into further layers until nothing new appears:

* lines with URL escapes (``%41``) and lines with Unicode escapes (``\\u0041``, ``\\x41``,
  ``\\u{41}``, ``&#65;``, ``&#x41;``), decoded in place so that their surroundings stay;
* base64 runs (both alphabets), each within its line and, where lines
  of one width follow each other, also joined over the line breaks; other bytes are scanned one
  character each, and where every second byte is null as UTF-16;
* compressed data (gzip, zlib, bzip2, xz, Zstandard) of any number of members within base64, and
  within itself.

Each character of a layer carries the span of the original text that it came from, so a match in
any layer is reported as a span of the original text: the matched escapes, the base64 digits that
hold the bytes, or, for compressed data, the whole run. Layers seen before in the same text are not
opened again, so cycles end. Base matches of the text itself always stay; a decoded match adds a
span if it is not among them.

A layer above MAX_LAYER bytes is scanned in overlapping blocks, which bounds memory but not time
against crafted data. ``n_refused`` counts what is left out: an unbroken base64 run above MAX_LAYER within
such a layer, which would have to be held as one; compressed data whose window takes more than
MAX_WINDOW; and a large layer in more than DEPTH layers of compression.

Defined cases: a null text counts as empty and has no span. Every row gives one row, repeated rows
too. Only the id and text columns are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of

KINDS = ("assign", "access", "hex")
MAX_LAYER = 32 << 20
#: Memory for the window of compressed data (xz dictionaries, Zstandard windows).
MAX_WINDOW = 512 << 20
#: Bytes decompressed at a time, and those of each block of a large layer that the next one repeats.
BLOCK = 1 << 20
TAIL = 1 << 16
#: Layers of compression around a large layer.
DEPTH = 64

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Whole runs: a run that is too short has no longer match inside.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# The shortest secret of any kind takes this many base64 digits.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}")
# Runs that go on over line breaks, up to the end of a line or a closing character.
_LINES = re.compile(
    r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=={0,2}[\x20\t]*+(?:[\r\n"'`<>)\]},;]|\Z)))++={0,2}"""
)
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
# Letters and signs of one byte each in either order of bytes; the shortest secret has 16.
_UTF16 = re.compile(rb"(?:[^\0]\0){16,}+|(?:\0[^\0]){16,}+")
_B64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_PRINTABLE = bytes(range(32, 127)) + b"\t\n\r"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, per kind from the left without overlap."""
    spans: list[Span] = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        spans.extend(("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12)
    if "AKIA" in text:
        spans.extend(("access", *m.span()) for m in _ACCESS.finditer(text))
    spans.extend(("hex", *m.span()) for m in _HEX.finditer(text))
    return spans


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


class Layer:
    """A decoded text and, per character, the span of the original text it stands for."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def part(self, start: int, end: int) -> Layer:
        return Layer(self.text[start:end], self.starts[start:end], self.ends[start:end])

    def through(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A text whose characters came from ``[starts, ends)`` of this layer."""
        return Layer(text, self.starts[starts], self.ends[ends - 1])


def _characters(raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 text of the bytes, bad ones replaced, with the byte span of each character."""
    try:
        text = raw.decode()
        sizes = np.fromiter((1 if c < "\x80" else len(c.encode()) for c in text), dtype=np.int64, count=len(text))
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        sizes = np.ones(len(text), dtype=np.int64)
    ends = np.cumsum(sizes)
    return text, ends - sizes, ends


def _in_place(layer: Layer, found: re.Pattern, decode: Callable[[re.Match], tuple[str, np.ndarray, np.ndarray] | None]) -> Layer | None:
    """The layer with every match replaced by what it stands for."""
    texts, starts, ends, at = [], [], [], 0
    for m in found.finditer(layer.text):
        decoded = decode(m)
        if decoded is None:
            continue
        plain = np.arange(at, m.start())
        texts += [layer.text[at : m.start()], decoded[0]]
        starts += [plain, decoded[1] + m.start()]
        ends += [plain + 1, decoded[2] + m.start()]
        at = m.end()
    if not at:
        return None
    plain = np.arange(at, len(layer.text))
    text = "".join([*texts, layer.text[at:]])
    return layer.through(text, np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]))


def _url(m: re.Match) -> tuple[str, np.ndarray, np.ndarray]:
    text, starts, ends = _characters(bytes.fromhex(m.group().replace("%", "")))
    return text, 3 * starts, 3 * ends


def _escape(m: re.Match) -> tuple[str, np.ndarray, np.ndarray] | None:
    number = int(m.group(5)) if m.group(5) else int(next(g for g in m.groups() if g), 16)
    if number > 0x10FFFF or 0xD800 <= number < 0xE000:
        return None
    return chr(number), np.array([0]), np.array([m.end() - m.start()])


def _lines_with(layer: Layer, found: re.Pattern) -> Iterator[Layer]:
    """The lines of a layer that hold a match, each once."""
    at = 0
    while m := found.search(layer.text, at):
        start = layer.text.rfind("\n", 0, m.start()) + 1
        end = layer.text.find("\n", m.end())
        end = len(layer.text) if end < 0 else end
        yield layer.part(start, end)
        at = end


class _File:
    """Blocks to be read as a file."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.rest = blocks, b""

    def read(self, size: int = -1) -> bytes:
        while not self.rest and (block := next(self.blocks, None)) is not None:
            self.rest = block
        out, self.rest = (self.rest, b"") if size < 0 else (self.rest[:size], self.rest[size:])
        return out


def _opener(head: bytes) -> object | None:
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=MAX_WINDOW)


def inflated(blocks: Iterator[bytes], refuse: Callable[[], None] = lambda: None) -> Iterator[bytes]:
    """Decompressed data of all members, in blocks, up to the first damage; nothing if not compressed.

    What follows the last member is passed on as it is. ``refuse`` is called for a member whose
    window takes more memory than allowed.
    """
    rest, opened = b"", False
    while True:
        while len(rest) < 6 and (more := next(blocks, None)) is not None:
            rest += more
        if not _compressed(rest):
            if opened and rest:
                yield rest
                yield from blocks
            return
        data, some = rest, False
        try:
            if rest.startswith(b"\x28\xb5\x2f\xfd"):
                source = _File(itertools.chain([rest], blocks))
                opener = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW)
                with opener.stream_reader(source, read_across_frames=True) as reader:
                    while out := reader.read(BLOCK):
                        some = True
                        yield out
                return
            member = _opener(rest)
            while not member.eof:
                out = member.decompress(data, BLOCK)
                if out:
                    some = True
                    yield out
                data = getattr(member, "unconsumed_tail", b"")
                if len(out) < BLOCK and not member.eof and not data and (data := next(blocks, None)) is None:
                    return
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError) as error:
            if "memory" in str(error).lower():
                refuse()
            if opened and not some:
                yield rest
            return
        rest, opened = member.unused_data.lstrip(b"\0"), True


def _readable(raw: bytes) -> bool:
    if raw.isascii():
        return len(raw.translate(None, _PRINTABLE)) <= 0.05 * len(raw)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.95 * len(text)


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Readable bytes as a text; others with each byte as a character, and their UTF-16 stretches."""
    if _readable(raw):
        yield _characters(raw)
        return
    places = np.arange(len(raw))
    yield raw.decode("latin-1"), places, places + 1
    for m in _UTF16.finditer(raw):
        text = m.group()[0 if m.group()[1] == 0 else 1 :: 2].decode("latin-1")
        starts = m.start() + 2 * np.arange(len(text))
        yield text, starts, starts + 2


def _unfinished(data: bytes) -> int:
    """Where the base64 run, over lines or not, starts that may go on after the data."""
    end = len(data)
    while True:
        start = data.rfind(b"\n", 0, end) + 1
        line = data[start:end].rstrip(b"\x20\t\r")
        if line.lstrip(b"\x20\t").translate(None, _B64):
            return start + len(line.rstrip(_B64))
        if not start:
            return 0
        end = start - 1


def _decoded(run: str) -> bytes | None:
    digits = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(digits) % 4 == 1:
        digits = digits[:-1]
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4))
    except (binascii.Error, ValueError):
        return None


def _base64(layer: Layer) -> Iterator[tuple[bytes, Layer]]:
    """Bytes of the base64 runs of a layer, with the run."""
    for m in _BASE64.finditer(layer.text):
        if (raw := _decoded(m.group())) is not None:
            yield raw, layer.part(m.start(), m.end())
    if "\n" not in layer.text:
        return
    for m in _LINES.finditer(layer.text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _DIGITS.finditer(m.group())]
        for first, end in _wrapped(layer.text, lines):
            parts = lines[first:end]
            if sum(b - a for a, b in parts) < 22:
                continue
            places = np.concatenate([np.arange(a, b) for a, b in parts])
            run = layer.through("".join(layer.text[a:b] for a, b in parts), places, places + 1)
            if (raw := _decoded(run.text)) is not None:
                yield raw, run


def _wrapped(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First line and end of each part that may be one wrapped run: lines of one width and a last one.

    A first line within other text may be shorter than those below. Compressed data may also start
    in any full line.
    """
    width = [b - a for a, b in lines]
    first = 0
    while first < len(lines) - 1:
        last = first
        while last + 1 < len(lines) and width[last + 1] == width[first]:
            last += 1
        if last + 1 < len(lines) and width[last + 1] < width[first]:
            last += 1
        if last > first:
            if first == 1 and width[0] < width[1] and text[: lines[0][0]].rpartition("\n")[2].strip():
                yield 0, last + 1
            yield first, last + 1
            for start in range(first + 1, last):
                head = _decoded(text[lines[start][0] : lines[start][0] + 8])
                if head and _compressed(head):
                    yield start, last + 1
        first = max(last, first + 1) if last == first or width[last] == width[first] else last + 1


def _compressed(raw: bytes) -> bool:
    zlib_head = raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0
    return zlib_head or raw.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ", b"\x28\xb5\x2f\xfd"))


class Scan:
    """The worklist of one text."""

    def __init__(self, text: str) -> None:
        self.base = base_spans(text)
        self.spans = dict.fromkeys(self.base)
        self.seen: set[bytes] = set()
        self.layers = self.refused = 0
        if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or _LINES.search(text)):
            return
        places = np.arange(len(text))
        self.work = [Layer(text, places, places + 1)]
        self._unwrap(self.work.pop())
        self._drain(0)

    def _drain(self, kept: int) -> None:
        """Scan and unwrap layers until so many are left."""
        while len(self.work) > kept:
            layer = self.work.pop()
            self.layers += 1
            for kind, start, end in base_spans(layer.text):
                self.spans.setdefault((kind, int(layer.starts[start:end].min()), int(layer.ends[start:end].max())))
            self._unwrap(layer)

    def _new(self, content: bytes) -> bool:
        mark = hashlib.blake2b(content, digest_size=16).digest()
        if mark in self.seen:
            return False
        self.seen.add(mark)
        return True

    def _add(self, layer: Layer | None) -> None:
        # The same text from another place is another layer: its spans differ.
        if layer is not None and layer.text and self._new(
            f"{layer.starts[0]}:{layer.ends[-1]}:{layer.text}".encode("utf-8", "replace")
        ):
            self.work.append(layer)

    def _unwrap(self, layer: Layer) -> None:
        if "%" in layer.text:
            for line in _lines_with(layer, _URL):
                self._add(_in_place(line, _URL, _url))
        if "\\" in layer.text or "&#" in layer.text:
            for line in _lines_with(layer, _ESCAPE):
                self._add(_in_place(line, _ESCAPE, _escape))
        for raw, run in _base64(layer):
            if _compressed(raw) and self._open(raw, run):
                continue
            for text, starts, ends in _texts(raw):
                if text:
                    self._add(run.through(text, starts * 4 // 3, np.minimum((ends * 4 + 2) // 3, len(run.text))))

    def _open(self, raw: bytes, run: Layer) -> bool:
        """Decompress, again and again, and add the texts as layers that stand for the whole run.

        False if the bytes are not compressed.
        """
        first, last = int(run.starts.min()), int(run.ends.max())
        place = f"raw {first}:{last}:".encode()
        opened = False
        while True:
            blocks, out = inflated(iter([raw]), self._refuse), bytearray()
            for block in blocks:
                out += block
                if len(out) > MAX_LAYER:
                    self._large(itertools.chain([bytes(out)], blocks), first, last)
                    return True
            if not out:
                break
            opened, raw = True, bytes(out)
            if not self._new(place + raw):
                return True
        if opened:
            self._whole(raw, first, last)
        return opened

    def _refuse(self) -> None:
        self.refused += 1

    def _whole(self, raw: bytes, first: int, last: int) -> None:
        for text, _, _ in _texts(raw):
            self._add(Layer(text, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text))))

    def _large(self, blocks: Iterator[bytes], first: int, last: int) -> None:
        """A layer beyond MAX_LAYER, block by block.

        Each block repeats the end of the one before, and a base64 run that is not at its end is
        carried on. One above MAX_LAYER is left out and counted as refused.
        """
        for _ in range(DEPTH):
            head = next(blocks, b"")
            if not _compressed(head):
                break
            inner = inflated(itertools.chain([head], blocks), self._refuse)
            if (out := next(inner, None)) is None:
                break
            head, blocks = b"", itertools.chain([out], inner)
        else:
            self.refused += 1
            return
        tail, skipping = b"", False
        for block in itertools.chain([head], blocks):
            if skipping:
                block = block.lstrip(_B64 + b"\x20\t\r\n")
                if not block:
                    continue
                skipping = False
            data = tail + block
            if len(data) < BLOCK:
                tail = data
                continue
            cut = _unfinished(data)
            self._piece(data[:cut], first, last)
            if len(data) - cut > MAX_LAYER:
                self.refused += 1
                tail, skipping = b"", True
            else:
                tail = data[max(0, min(cut, len(data) - TAIL)) :]
            if all((kind, first, last) in self.spans for kind in KINDS):
                return
        cut = _unfinished(tail)
        if len(tail) - cut > MAX_LAYER:
            self.refused += 1
            tail = tail[:cut]
        self._piece(tail, first, last)

    def _piece(self, data: bytes, first: int, last: int) -> None:
        kept = len(self.work)
        self._whole(data, first, last)
        self._drain(kept)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.id, batch.body, strict=True):
            scan = Scan(text)
            counts = [sum(kind == k for k, _, _ in scan.base) for kind in KINDS]
            digest = hashlib.sha256(joined(scan.base).encode()).hexdigest()
            rows.append((doc, *counts, digest, joined(list(scan.spans)), len(scan.spans) - len(set(scan.base)), scan.layers, scan.refused))
        out = pd.DataFrame(
            rows, columns=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_layers", "n_refused"]
        )
        out["id"] = out["id"].astype(batch.id.dtype)
        yield out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    ``n_decoded`` counts the spans that decoding added, ``n_layers`` the decoded layers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body")).mapInPandas(
        _scan,
        f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
        "n_decoded bigint, n_layers bigint, n_refused bigint",
    )
    return found.withColumnRenamed("id", id_col)
