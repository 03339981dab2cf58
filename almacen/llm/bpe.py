"""4. BPE encoding by a per-prefix dynamic programme, and decoding.

For every prefix of a pretoken, the last token of its BPE encoding is unique.
An automaton over the vocabulary yields all tokens that end at a position; a
token is the last one there exactly if the last token of the prefix before it
is compatible, i.e. if no merge across their border comes before the merges
that build the two. Following the stored last tokens back from the end gives
the ids. The work is linear in the text, however long a pretoken is.

Defined cases: a null text is empty and has no ids; strings of added tokens
in a text become their ids; very long texts are encoded whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .packing import _byte_letters

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixBPE:
    """Byte-level BPE read from a tokenizers JSON file; ids equal that library's."""

    PRETOKEN = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    GAP = re.compile(r"\s\s|\s\Z")
    MEMO, PAIRS = 300_000, 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letter_to_byte = {v: k for k, v in _byte_letters().items()}

        def to_bytes(token: str) -> bytes:
            return bytes(letter_to_byte.get(c, ord(c) & 255) for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: to_bytes(t) for t, i in model["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
                                      + ")") if self.added else None
        self._build(model)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _build(self, model) -> None:
        import ahocorasick
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = vocab[a], vocab[b]
            self.rank[x, y] = r
            parts.setdefault(vocab[a + b], (x, y))
        # A token's borders while it is built: what stands at its right (left) end, and
        # the rank of the merge after which it does.
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.compatible: dict[int, bool] = {}
        usable = []
        for t in sorted(vocab.values(), key=lambda i: len(self.bytes_of[i])):
            if t not in parts:
                if len(self.bytes_of[t]) == 1:
                    self.right[t] = self.left[t] = [(t, -1)]
                    usable.append(t)
                continue
            x, y = parts[t]
            if x in self.right and y in self.right and self._border(x, y) == self.rank[x, y]:
                self.right[t] = self.right[y] + [(t, self.rank[x, y])]
                self.left[t] = self.left[x] + [(t, self.rank[x, y])]
                usable.append(t)
        self.automaton = ahocorasick.Automaton()
        for t in usable:
            self.automaton.add_word(self.bytes_of[t].decode("latin-1"), (t, len(self.bytes_of[t])))
        self.automaton.make_automaton()

    def _border(self, x: int, y: int):
        """Rank of the first merge across the border of ``x`` and ``y`` that happens
        before either is complete, or of the merge of the two; None if there is none.

        Both sides are replayed in rank order. Of equal ranks the leftmost pair
        goes first: one inside ``x`` precedes the border, which precedes ``y``.
        """
        rs, ls, i, j = self.right[x], self.left[y], 0, 0
        while True:
            across = self.rank.get((rs[i][0], ls[j][0]))
            next_x = rs[i + 1][1] if i + 1 < len(rs) else None
            next_y = ls[j + 1][1] if j + 1 < len(ls) else None
            if across is not None and (next_x is None or across < next_x) and (next_y is None or across <= next_y):
                whole = next_x is None and next_y is None
                return across if whole else -1
            if next_x is None and next_y is None:
                return None
            if next_y is None or next_x is not None and next_x <= next_y:
                i += 1
            else:
                j += 1

    def _fits(self, x: int, y: int) -> bool:
        if len(self.compatible) >= self.PAIRS:
            self.compatible.clear()
        fits = self.compatible[x << 20 | y] = self._border(x, y) is None
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        last = [-1] * (len(piece) + 1)
        known = self.compatible.get
        for at, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            if start := end - length:
                before = last[start]
                fits = known(before << 20 | token)
                if fits is None:
                    fits = self._fits(before, token)
                if not fits:
                    continue
            last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def _span(self, text: str) -> bytes:
        out = []
        for p in self.PRETOKEN.findall(text):
            ids = self.pieces.get(p)
            if ids is None:
                if len(self.pieces) >= self.MEMO:
                    self.pieces.clear()
                ids = array("I", self.encode_piece(p.encode())).tobytes()
                if len(p) <= 64:
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if self.GAP.search(text):
            return self._span(text)
        # Single spaces only: no pretoken crosses one, so each word with the space before it is known by itself.
        first, *rest = text.split(" ")
        known, new = self.chunks.get, self._chunk
        return self._span(first) + b"".join([known(w) or new(w) for w in rest])

    def _chunk(self, word: str) -> bytes:
        ids = self._span(" " + word)
        if len(self.chunks) >= self.MEMO:
            self.chunks.clear()
        if len(word) <= 64:
            self.chunks[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added_split is None or not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(array("I", [self.added[s]]).tobytes() if s in self.added else self._plain(s)
                        for s in self.added_split.split(text) if s)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBPE:
    """One encoder per worker process and file: later tasks of the process start with its tables and memos."""
    return PrefixBPE(path)


def _digests(batches, path: str):
    bpe = encoder(path)
    for b in batches:
        n, ids_sha, text_sha = [], [], []
        for text in b.column(1):
            ids = bpe.encode(text.as_py() or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
             pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches, path: str):
    bpe = encoder(path)
    for b in batches:
        ids = [memoryview(bpe.encode(t.as_py() or "")).cast("I").tolist() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                         names=["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)``."""
    return docs.select("doc_id", "text").mapInArrow(lambda bs: _encoded(bs, tokenizer),
                                                    "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, decode and digest in the same task, so that ids never cross a process border."""
    return docs.select("doc_id", "text").mapInArrow(lambda bs: _digests(bs, tokenizer), SCHEMA)
