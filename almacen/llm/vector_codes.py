"""11. Vector code compression: product codes by slice-and-intersect bitmasks.

Components become integers, a vector is cut into ``PARTS`` parts, and each part
is coded by the nearest of its position's 64 codebook entries. The nearest entry
is found exactly without looking at all entries: per dimension the entries'
coordinates are sorted, and the i-th of the sorted coordinates carries a 64-bit
mask of the i entries before it. The distance to an entry near in some
dimension gives an initial radius; in every dimension the radius selects a
range of sorted coordinates, whose entries are the difference of two prefix
masks, and the masks of all dimensions are intersected. No entry outside the
intersection can be as near as the radius, so comparing the few inside, in
rising order, is exact, ties included.

The codebooks (``64 * dimensions`` integers, a size that does not depend on the
rows) go to the tasks; each task adds up its own parts per entry, so a round
moves ``PARTS * 64`` rows of sums a task. Errors per label are partial sums
joined back, so a label with a third of all rows is not gathered anywhere.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
component are dropped; so are vectors of another length than the commonest
multiple of ``PARTS`` (of equally common ones the greater). Components beyond
plus or minus 262,144 count as that. Rows that repeat a ``vec_id`` are coded
each for itself, a null ``vec_id`` comes last among the first entries; of equal
ids the lesser vector is the earlier entry. Fewer than 64 rows make as many
entries. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vantage import common_length, finite

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26


class MaskIndex:
    """Exact nearest entries of one codebook of at most 64 integer vectors."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, self.order, axis=0).T)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(np.uint64(1) << self.order.T.astype(np.uint64), axis=1)

    def _apart(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[entry]
        return np.einsum("ij,ij->i", d, d)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number no less than the distance to the nearest entry: that to the best neighbour in one dimension."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for j, row in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(row, x[:, j]), len(row) - 1)
            best = np.minimum(best, self._apart(x, self.order[at, j]))
        r = np.sqrt(best).astype(np.int64)
        return r + (r * r < best)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` in every dimension."""
        mask = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j, row in enumerate(self.sorted):
            low = np.searchsorted(row, x[:, j] - radius, side="left")
            high = np.searchsorted(row, x[:, j] + radius, side="right")
            mask &= self.prefix[j, high] ^ self.prefix[j, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row of ``x``, ties to the lower index."""
        mask = self.candidates(x, self.radius(x))
        rows = np.arange(len(x))
        found, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        while len(rows):
            low = mask & (~mask + np.uint64(1))
            entry = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            apart = self._apart(x[rows], entry)
            better = apart < best[rows]
            found[rows[better]], best[rows[better]] = entry[better], apart[better]
            mask ^= low
            more = mask != 0
            rows, mask = rows[more], mask[more]
        return found, best


def _parts(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, -1)


def _sums(batches, books: np.ndarray):
    """Per part position and used entry: the number of parts nearest to it and their sums."""
    index = [MaskIndex(b) for b in books]
    count = np.zeros(books.shape[:2], np.int64)
    total = np.zeros(books.shape, np.int64)
    for b in batches:
        if not len(b):
            continue
        x = _parts(b.column(0))
        for p, one in enumerate(index):
            entry, _ = one.nearest(x[:, p])
            count[p] += np.bincount(entry, minlength=len(count[p]))
            np.add.at(total[p], entry, x[:, p])
    part, entry = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
         pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])


def _codes(batches, books: np.ndarray):
    index = [MaskIndex(b) for b in books]
    for b in batches:
        x = _parts(b.column(2)) if len(b) else np.zeros((0, PARTS, 1), np.int64)
        code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
        for p, one in enumerate(index if len(x) else ()):
            code[:, p], apart = one.nearest(x[:, p])
            error += apart
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()),
             pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that are kept, written: ``v`` holds the integer components."""
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", "label", x.alias("x")).filter(finite(F.col("x")))
    dims = common_length(kept, "x", PARTS)
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))),
                                                          F.lit(-float(LIMIT)))).cast("int"))
    return staged(kept.filter(F.size("x") == dims).select("vec_id", "label", whole.alias("v")), "codes-vectors")


def train(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``PARTS x entries x dimensions of a part`` of ``kept(v)``."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64)
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = (kept.select("v").mapInArrow(lambda bs, b=books: _sums(bs, b), "part int, entry int, n long, total array<long>")
                .groupBy("part", "entry")
                .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(books.shape[2])]).alias("total")))
        books = books.copy()
        for r in sums.collect():            # PARTS * ENTRIES rows at most
            books[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return books


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for the kept rows of ``vectors(vec_id, embedding, label)``."""
    kept = integer_vectors(vectors)
    label = dict(kept.dtypes)["label"]
    books = train(kept)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    ids = dict(kept.dtypes)["vec_id"]
    coded = staged(kept.select("vec_id", "label", "v").mapInArrow(
        lambda bs: _codes(bs, books), f"vec_id {ids}, label {label}, code string, error long"), "codes-coded")
    per_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return (coded.join(per_label, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
