"""5. Secret scan over a worklist of decoded layers.

The text itself is the first layer. Each layer is scanned, and its URL
escapes, Unicode escapes, base64 runs and compressed contents are unwrapped
into new layers until nothing new appears; a digest per layer stops cycles.
A base64 run is read at its four phases, so that what is written before the
blob does not matter, and over line breaks; compressed contents are found at
any place of the decoded bytes, member after member, and read up to a damage;
bytes that are not UTF-8 are read one character each, and as UTF-16 where every
second byte is null.
Every character of a layer knows the span of the original text it comes
from, so a secret found in any layer is reported by its place in the text; all
of a blob's content has the blob's span, which is kept once.

Layers are unwrapped one inside another, the next one only when the last is
done, and compressed contents come as a stream in windows of ``WINDOW`` bytes that
overlap by ``OVERLAP``, so memory does not depend on how much a blob unwraps to.

Defined cases: a null text is empty and has no span; whole texts are scanned,
and whole contents. What is compressed inside a compressed content is read from a window; if
one that takes more than ``OVERLAP`` bytes runs over a window's end, the rest of it is
not read and its blob is reported as an ``opaque`` span, never passed over silently;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, sliced

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                    r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
BACKSLASH = re.compile(ESCAPE.pattern + r"|\\([nrtabfv0\\'\"])")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Lines of base64, broken by line ends or by their escapes, perhaps indented or quoted.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*(?:\r\n|\n|\r|(?:\\r)?\\n)[ \t>]*[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"\\r\\n|\\n|[\s>]+")
# How gzip, zlib, bzip2, xz and zstd begin.
MAGIC = r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd"
MAGIC, MAGIC_BYTES = re.compile(MAGIC), re.compile(MAGIC.encode("latin-1"))
BYTES = re.compile(r"[\x00-\xff]+")
CHUNK = 256
WINDOW, OVERLAP, PIECE = 8 << 20, 1 << 20, 1 << 20
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and the span of the original it stems from: per character, one for all of it, or (None) itself."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[start], max(self.ends[start:end])

    def replaced(self, pattern: re.Pattern, decode) -> "Layer | None":
        """This layer with each match decoded; None if nothing was."""
        whole = isinstance(self.starts, int)
        pieces, starts, ends, at = [], array("q"), array("q"), 0

        def keep(a, b):
            pieces.append(self.text[a:b])
            if not whole:
                starts.extend(range(a, b) if self.starts is None else self.starts[a:b])
                ends.extend(range(a + 1, b + 1) if self.ends is None else self.ends[a:b])
        for m in pattern.finditer(self.text):
            plain = decode(m)
            if plain is None:
                continue
            keep(at, m.start())
            pieces.append(plain)
            at = m.end()
            if whole:
                continue
            s, e = self.span(m.start(), m.end())
            if len(plain) * 3 == m.end() - m.start() and self.starts is None and plain.isascii():
                starts.extend(range(s, e, 3))
                ends.extend(range(s + 3, e + 1, 3))
            else:
                starts.extend(array("q", [s]) * len(plain))
                ends.extend(array("q", [e]) * len(plain))
        if not pieces:
            return None
        keep(at, len(self.text))
        return Layer("".join(pieces), self.starts, self.ends) if whole else Layer("".join(pieces), starts, ends)


def _percent(m: re.Match) -> str:
    return _text(bytes.fromhex(m[0].replace("%", "")))


def _escape(m: re.Match) -> str | None:
    g = next((i, x) for i, x in enumerate(m.groups()) if x is not None)
    if g[0] == 6:
        return SIMPLE.get(g[1], g[1])
    code = int(g[1], 10 if g[0] == 4 else 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _byte(m: re.Match) -> str | None:
    return "\0" if m[0].lower() in ("\\x00", "\\u0000", "&#0;") else _escape(m)


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        # A window may begin or end within a character.
        cut = data[next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0):]
        if e.reason == "unexpected end of data" or len(cut) < len(data):
            for end in range(len(cut), max(len(cut) - 4, 0), -1):
                try:
                    return cut[:end].decode("utf-8")
                except UnicodeDecodeError:
                    pass
        return data.decode("latin-1")


def _texts(data: bytes):
    """``data`` as text, and as UTF-16 if a quarter or more of every second byte is null or a mark says so."""
    yield _text(data)
    half = max(1, len(data) // 2)
    if data[:2] == b"\xff\xfe" or 4 * data[1::2].count(0) >= half:
        yield data[:len(data) // 2 * 2].decode("utf-16-le", "replace")
    if data[:2] == b"\xfe\xff" or 4 * data[::2].count(0) >= half:
        yield data[:len(data) // 2 * 2].decode("utf-16-be", "replace")


def _tool(data):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _pieces(data):
    """The contents of the compressed members at the start of ``data`` in pieces, up to its end or a damage.
    Returns how many bytes they take, and whether ``data`` ended within a member."""
    import zstandard
    view, at = memoryview(data), 0
    while at < len(view):
        if bytes(view[at:at + 4]) == b"\x28\xb5\x2f\xfd":
            tool, bounded = zstandard.ZstdDecompressor().decompressobj(), False     # a few MB for ``CHUNK`` bytes at most
        elif tool := _tool(bytes(view[at:at + 8])):
            bounded = True
        else:
            break
        start, some = at, False
        try:
            while at < len(view) and not tool.eof:
                part, at = view[at:at + CHUNK], min(at + CHUNK, len(view))
                while True:
                    piece = tool.decompress(part, PIECE) if bounded else tool.decompress(part)
                    if piece:
                        some = True
                        yield piece
                    part = getattr(tool, "unconsumed_tail", b"")
                    if tool.eof or not (part or piece and not getattr(tool, "needs_input", True)):
                        break
        except (zlib.error, zstandard.ZstdError, OSError, lzma.LZMAError, EOFError, ValueError):
            return at if some else start, False
        if not tool.eof:
            return at, some
        at -= len(tool.unused_data)
    return at, False


def _members(data: bytes, last: bool, base: int = 0):
    """``(window, whether it is the last)`` of all that is compressed in ``data``; None if a member runs over its end,
    ``data`` is not the last window and the next one does not hold the member whole. Returns where the members end."""
    done, view = 0, memoryview(data)
    for m in MAGIC_BYTES.finditer(data, base):
        if m.start() < done:
            continue
        pieces, window, any_ = _pieces(view[m.start():]), bytearray(), False
        while True:
            try:
                window += next(pieces)
            except StopIteration as end:
                used, cut = end.value
                break
            any_ = True
            while len(window) > WINDOW:
                yield bytes(window[:WINDOW]), False
                del window[:WINDOW - OVERLAP]
        if any_:
            yield bytes(window), True
            done = m.start() + used
        if cut and not last and m.start() < len(data) - OVERLAP:
            yield None


def _contents(data: bytes):
    """The texts of ``data`` and of all that is compressed in it, at any place and depth; None for what is cut."""
    seen, open_ = set(), [iter([(data, True)])]
    while open_:
        one = next(open_[-1], StopIteration)
        if one is StopIteration:
            open_.pop()
            continue
        if one is None:
            yield None
            continue
        known = hashlib.sha256(one[0]).digest()
        if not one[0] or known in seen:
            continue
        seen.add(known)
        yield from _texts(one[0])
        open_.append(_members(*one))


def _phases(run: str):
    """The bytes of a base64 run, read from each of its first four characters."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for phase in range(4):
        part = body[phase:]
        part = part[:-1] if len(part) % 4 == 1 else part
        if part:
            yield base64.b64decode(part + "=" * (-len(part) % 4))


def unwrap(layer: Layer):
    """The layers directly inside ``layer``; an int pair marks a blob that could not be read to its end."""
    text = layer.text

    def inside(s: int, e: int, contents):
        for plain in contents:
            yield (s, e) if plain is None else Layer(plain, s, e)

    def inflated(raw: Layer):
        """What is compressed in bytes that are spelled one character each; every run of them is encoded once."""
        run, start, end = b"", 0, 0
        done = 0
        for m in MAGIC.finditer(raw.text):
            if m.start() < done:
                continue
            if m.start() >= end:
                start, end = BYTES.match(raw.text, m.start()).span()
                run = raw.text[start:end].encode("latin-1")
            at = m.start() - start
            # The span of the members is known when they are read, that of their run before.
            probe = _pieces(memoryview(run)[at:])
            try:
                while not next(probe):
                    pass
            except StopIteration:
                continue
            used = _used(probe)
            done = m.start() + used
            yield from inside(*raw.span(m.start(), done), _contents(run[at:at + used]))
    if "%" in text and (inner := layer.replaced(PERCENT, _percent)):
        yield inner
        yield from inflated(layer.replaced(PERCENT, lambda m: bytes.fromhex(m[0].replace("%", "")).decode("latin-1")))
    if ("\\" in text or "&#" in text) and (inner := layer.replaced(ESCAPE, _escape)):
        yield inner
        yield from inflated(layer.replaced(BACKSLASH, _byte))
    for m in BASE64.finditer(text):
        for data in _phases(m[0]):
            yield from inside(*layer.span(*m.span()), _contents(data))
    if "\n" in text or "\r" in text or "\\n" in text:
        for m in WRAPPED.finditer(text):
            if len(run := BREAK.sub("", m[0])) >= 16:
                for data in _phases(run):
                    yield from inside(*layer.span(*m.span()), _contents(data))


def _used(pieces) -> int:
    """Read on to the end of the members: how many bytes they take."""
    while True:
        try:
            next(pieces)
        except StopIteration as end:
            return end.value[0]


def find_secrets(text: str) -> tuple[list, list]:
    """``(base spans, all spans)``, each sorted by start, kind and end."""
    base = sorted(scan(text))
    spans = set(base)
    # A layer is known by its content and place: equal blobs elsewhere are unwrapped again, a cycle is not.
    seen, open_ = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}, [unwrap(Layer(text))]
    while open_:
        inner = next(open_[-1], None)
        if inner is None:
            open_.pop()
            continue
        if isinstance(inner, tuple):
            spans.add((inner[0], 3, inner[1]))
            continue
        known = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), *inner.span(0, len(inner.text)))
        if known in seen or not inner.text:
            continue
        seen.add(known)
        for start, kind, end in scan(inner.text):
            s, e = inner.span(start, end)
            spans.add((s, kind, e))
        open_.append(unwrap(inner))
    return base, sorted(spans)


def spelled(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanned(batches):
    for b in sliced(batches):
        rows = []
        for text in b.column(1):
            base, every = find_secrets(text.as_py() or "")
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)),
                         hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:3]],
             *[pa.array(c, pa.string()) for c in cols[3:]]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and spans for every row of ``docs(doc_id, text)``."""
    return lean(docs).select("doc_id", "text").mapInArrow(_scanned, SCHEMA)


def _redacted(batches, names: list[str], mark: str):
    at = names.index("text")
    for b in sliced(batches):
        texts = []
        for value in b.column(at):
            text = value.as_py()
            if text is not None:
                out, done = [], 0
                for s, _, e in find_secrets(text)[1]:
                    if e > done:
                        out += [text[done:max(s, done)], mark if s >= done else ""]
                        done = e
                text = "".join(out) + text[done:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span, merged where they overlap, replaced by ``mark``."""
    names = docs.columns
    return lean(docs).mapInArrow(lambda bs: _redacted(bs, names, mark), docs.schema)
