"""2. Packing token sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its documents once. A document's full windows stand
alone; its remainder waits in a buffer. A full buffer is packed: every item
starts as a partial partition (itself, and empty bins); the two partial
partitions of the largest imbalance are merged again and again, the heaviest
bins of one with the lightest of the other, until one partition into
near-equal windows is left. If a window exceeds the capacity, the number of
windows rises by one and the buffer is packed anew; once more than
``slack`` of the windows would be added, the larger items are cut in half
instead, which makes the next partition more even.

A task holds one buffer of remainders (under ``buffer_docs * capacity`` ids)
besides the batch at hand, so memory does not depend on the input, and no row
moves between tasks. Only the last buffer of a task may fill its windows badly.

Defined cases: a null text is empty and has the end id alone; a very long
text is cut into full windows and one remainder; rows repeating an id are
packed separately; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, sliced

CAPACITY, END_ID, BUFFER_DOCS, SLACK = 2048, 1, 256, 0.02
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class WordEncoder:
    """Ids of a lower-casing word BPE, as the tokenizers library gives them.

    White space separates words, so a text's ids are those of its
    white-space-separated chunks in a row, and chunks are remembered. Chunks
    of ASCII and extended Latin are split here and their pieces encoded by the
    library's model; other chunks, and texts with the strings of special
    tokens or control characters that are white space only to Python, are
    encoded by the whole library.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile("[!-~\u00c0-\u024f]+")
    #: A word of letters that lower-case one by one, and punctuation: two pieces at most.
    WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")
    ODD = re.compile("[\x1c-\x1f]")
    MEMO = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            if len(self.pieces) >= self.MEMO:
                self.pieces.clear()
            spelled = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[p] = array("I", [t.id for t in self.lib.model.tokenize(spelled)]).tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if m := self.WORD.fullmatch(chunk):
            word, rest = m.groups()
            ids = self._piece(word.lower())
            if rest:
                ids += self._piece(rest)
        elif self.PLAIN.fullmatch(chunk):
            ids = b"".join(map(self._piece, self.SPLIT.findall(chunk.lower())))
        else:
            ids = self._whole(chunk)
        if len(self.chunks) >= self.MEMO:
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special) or self.ODD.search(text):
            return self._whole(text)
        known, new = self.chunks.get, self._chunk
        return b"".join([known(c) or new(c) for c in text.split()])


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process and file: later tasks of the process start with its memos."""
    return WordEncoder(path)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes in order for the code points from 256 on."""
    spare, table = 256, {}
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            table[b] = chr(spare)
            spare += 1
    return table


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into ``k`` near-equal bins."""
    # A partial partition: its non-empty bins by falling load, relative to its lightest bin.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, la, ba = heapq.heappop(heap)
        _, _, lb, bb = heapq.heappop(heap)
        if len(la) + len(lb) <= k:
            if la[-1] >= lb[0]:
                la.extend(lb)
                ba.extend(bb)
            else:
                both = sorted(zip(la + lb, range(len(la) + len(lb))), key=lambda x: -x[0])
                bins = ba + bb
                la, ba = [x for x, _ in both], [bins[i] for _, i in both]
        else:
            loads, bins = np.zeros(k, np.int64), ba + [[] for _ in range(k - len(ba))]
            loads[:len(la)] = la
            loads[k - len(lb):] += np.asarray(lb[::-1], np.int64)
            for j, other in enumerate(bb):
                bins[k - 1 - j] = bins[k - 1 - j] + other
            order = np.argsort(-loads, kind="stable")
            la, ba = loads[order].tolist(), [bins[i] for i in order]
        if len(la) == k and la[-1]:
            low = la[-1]
            la = [x - low for x in la]
        spread = la[0] - (la[-1] if len(la) == k else 0)
        heapq.heappush(heap, (-spread, serial, la, ba))
        serial += 1
    bins = heap[0][3] if heap else []
    return bins + [[] for _ in range(k - len(bins))]


def pack(lengths: list[int], capacity: int = CAPACITY, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(item, start, length)`` that hold every item wholly, in cuts if need be."""
    items = [(i, 0, n) for i, n in enumerate(lengths) if n]
    total = sum(lengths)
    while items:
        sizes = [n for _, _, n in items]
        k = fewest = -(-total // capacity)
        largest = max(sizes)
        while k <= fewest + max(1, int(slack * fewest)) or largest <= 16:
            bins = differencing(sizes, k)
            if all(sum(sizes[i] for i in b) <= capacity for b in bins):
                return [[items[i] for i in sorted(b)] for b in bins if b]
            k += 1
        cut = []
        for i, start, n in items:
            if 2 * n > largest:
                cut += [(i, start, n // 2), (i, start + n // 2, n - n // 2)]
            else:
                cut.append((i, start, n))
        items = cut
    return []


def _packed(batches, path: str, capacity: int, end_id: int, buffer_docs: int):
    encoder = encoder_of(path)
    sequence = TaskContext.get().partitionId() << 40
    end = array("I", [end_id]).tobytes()
    waiting: list[tuple] = []
    out: list[tuple] = []

    def emit(doc, ids, start, length, base, total, seq, offset):
        out.append((doc, base + start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total, seq, offset))

    def flush():
        nonlocal sequence
        for window in pack([len(ids) // 4 for _, ids, _, _ in waiting], capacity):
            offset = 0
            for i, start, length in window:
                doc, ids, base, total = waiting[i]
                emit(doc, ids, start, length, base, total, sequence, offset)
                offset += length
            sequence += 1
        waiting.clear()

    def batch():
        cols = list(zip(*out)) or [[]] * 7
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for b in sliced(batches):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = encoder.encode(text or "") + end
            total = len(ids) // 4
            full = total // capacity * capacity
            for start in range(0, full, capacity):
                emit(doc, ids, start, capacity, 0, total, sequence, 0)
                sequence += 1
            if total > full:
                waiting.append((doc, ids[4 * full:], full, total))
            if len(waiting) >= buffer_docs:
                flush()
        if out:
            yield batch()
    flush()
    yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   buffer_docs: int = BUFFER_DOCS) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of
    ``docs(doc_id, text)`` under the tokenizers file ``tokenizer``."""
    return lean(docs).select("doc_id", "text").mapInArrow(
        lambda batches: _packed(batches, tokenizer, capacity, end_id, buffer_docs), SCHEMA)
