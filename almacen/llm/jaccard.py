"""8. N-gram Jaccard join: links between texts whose shingle sets are nearly equal.

Two sets of sizes a <= b link when ``100 |A & B| >= percent |A | B|``. With
``t = percent / 100`` that means ``b <= a / t`` and a symmetric difference of
at most ``(1 - t) / (1 + t) (a + b)``.

1. One pass turns every whole text into its set of 64-bit shingle hashes, and
   the set into a size, a key and a bitmap of two bits an element or more. Texts
   with equal sets form a class; from here on only classes count. A task
   gives the signatures of step 2 once per class, so that a large group of
   copies is reduced before anything moves.
2. Sizes fall into bands such that linked sets lie in the same or the next
   band. A band and its successor are a family; with ``d`` the largest
   possible difference of a linked pair of the family, its sets are split
   into a few more than ``d`` buckets by hash, of which all but ``d`` must be
   equal in both sets, and one of these is not empty. Classes that agree in a bucket are candidates; the buckets' classes,
   and their connected components, hold every link, so the pairs of other classes are never looked at.
   Some thousand rows at a time are packed, in the pass of step 1: by the first bits of a signature, with 4 bytes for
   the bits that follow and 2 for the row. (Signatures that differ only after these bits make a candidate more, never one
   less.) A task unpacks and sorts a place, that is a range of signatures, at a time.
3. Within a component, or, where it is larger than a tile, among the sets that share
   a bucket, size-banded tiles are compared pairwise by bitmap: a
   differing bit is an element of one set only, which bounds the overlap from
   above. Sets, with 8 bytes an element, do not move here. A set that the bound
   admits to no other is done; the others form components again, of the pairs admitted.
4. For these the sorted arrays are made again from their texts and tiled by component,
   where exact intersection settles the pairs. Pairs that earlier links of the same
   comparison connect are skipped: links are needed only to span a component.
5. The components of the links give the smallest reachable ``doc_id``.

The tiles of a group hold ``TILE_DOCS`` sets or ``TILE_HASHES`` hashes at
most, whatever the component's size, and are dealt over tasks.

Defined cases: a null or empty text, or one without words, has no shingle and
links with nothing; fewer words than ``n`` count as one shingle; rows that
repeat a ``doc_id`` with different texts are linked by each text on its own;
rows with a null id take the component of the rows of equal sets, null if there
are none; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .common import components, id_filter, lean, maybe_in, sliced, staged

N, PERCENT = 3, 90
SEEN = 1 << 15
TILE_DOCS, TILE_HASHES = 512, 1 << 20
#: The least bitmap has two to this power of bits.
BITS = 10
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MEMO = 1 << 15
#: Signatures are packed by their first bits, so many or more (a place, compared by one task), and so many a place at a time.
PLACE_BITS, PACK = 12, 64


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, n: int = N):
        import xxhash
        self.n, self.memo, self.hash = n, {}, xxhash.xxh64_intdigest

    def _word(self, w: bytes) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        h = self.memo[w] = self.hash(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        # Bytes lower-case A-Z alone and split at the six white-space characters of the contract alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known, new = self.memo.get, self._word
        h = np.array([known(w) or new(w) for w in words], np.uint64)
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
        return np.unique(out)


def _bands(top: int, percent: int) -> list[int]:
    """Lower bounds of the size bands up to ``top`` and two more: sets linked to a
    set below ``bounds[i + 1]`` are smaller than ``bounds[i + 2]``."""
    bounds = [1, 2]
    while len(bounds) < 3 or bounds[-3] <= top:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
    return bounds


class Signatures:
    """Hashes of the contents of a set's buckets, for both families of its band."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.bounds = _bands(1 << 20, percent)

    def band(self, size: int) -> int:
        if size >= self.bounds[-3]:
            self.bounds = _bands(2 * size, self.percent)
        return bisect.bisect_right(self.bounds, size) - 1

    def difference(self, family: int) -> int:
        """Largest symmetric difference of linked sets of bands ``family`` and the next."""
        small, large = self.bounds[family + 1] - 1, self.bounds[family + 2] - 1
        return (small + large) * (100 - self.percent) // (100 + self.percent)

    def buckets(self, family: int) -> int:
        """More than the difference by one and by the empty buckets to expect of a family's smallest set."""
        least = self.difference(family) + 1
        empty = least * math.exp(-self.bounds[family] / least)
        return least + 1 + int(empty + 3 * math.sqrt(empty))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out, band = [], self.band(len(hashes))
        spread = _mix(hashes + np.uint64(1))
        for family in (band - 1, band):
            if family < 0 or (d := self.difference(family)) == 0:
                continue                    # only equal sets can link, and these are one class
            n = self.buckets(family)
            bucket = (hashes % np.uint64(n)).astype(np.int64)
            total = np.zeros(n, np.uint64)
            np.add.at(total, bucket, spread)
            sigs = _mix(total + _mix(np.arange(n, dtype=np.uint64) + np.uint64(family << 24) + np.uint64(7)))
            # Linked sets agree in n - d buckets or more. Only if both have so many empty ones can
            # these be all they agree in; else an empty bucket says nothing and is not given.
            full = np.bincount(bucket, minlength=n) > 0
            out.append(sigs[full] if n - int(full.sum()) < n - d else sigs)
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _key(hashes: np.ndarray) -> list[int]:
    """Two sums that tell a class of equal sets, together with their size."""
    sums = [hashes.sum(dtype=np.uint64), _mix(hashes ^ MIX2).sum(dtype=np.uint64)]
    return np.array(sums, np.uint64).view(np.int64).tolist()


def _packed_buckets(base: int, sigs: list[np.ndarray], bits: int) -> tuple[np.ndarray, list, list]:
    """The signatures of rows ``base``, ``base + 1``, ... as ``place, at, own``, packed by place: the first ``bits``
    bits of a signature. ``at`` has the 32 bits that follow, ``own`` the rows, counted from ``base``."""
    own = np.repeat(np.arange(len(sigs), dtype=np.uint64), [len(x) for x in sigs])
    key = np.sort(np.concatenate(sigs).view(np.uint64) >> np.uint64(32 - bits) << np.uint64(16) | own)
    place = (key >> np.uint64(48)).astype(np.int32)
    at, own = (key >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype("<u4"), (key & np.uint64(0xFFFF)).astype("<u2")
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[start, len(key)]
    return place[start], *(pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (at, own))


def _profiles(batches, n: int, percent: int, bits: int, task: Callable[[], int]):
    """Rows ``(doc_id, text, ...)`` with size, key, bitmap and a number ``node``, and among them, where ``place`` is
    not null, the packed buckets of the rows before."""
    shingles, signatures = Shingler(n), Signatures(percent)
    none, seen, node = np.empty(0, np.int64), set(), task() << 33
    schema, base, waiting, held = None, node, [], 0

    def packed() -> pa.RecordBatch:
        place, at, own = _packed_buckets(base, waiting, bits)
        own_columns = {"node": pa.array(np.full(len(place), base, np.int64)), "place": pa.array(place), "at": at, "own": own}
        return pa.RecordBatch.from_arrays([own_columns.get(f.name, pa.nulls(len(place), f.type)) for f in schema], schema=schema)
    for b in sliced(batches):
        rows = []
        for text in b.column(1):
            h = shingles(text.as_py())
            if not len(h):
                rows.append((0, 0, 0, None))
                waiting.append(none)
                continue
            k1, k2 = _key(h)
            first = (len(h), k1, k2) not in seen
            if first:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((len(h), k1, k2))
            rows.append((len(h), k1, k2, _bitmap(h) if first else None))
            waiting.append(signatures(h) if first else none)
            held += len(waiting[-1])
        size, k1, k2, maps = zip(*rows) if rows else ([], [], [], [])
        out = pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(k1, pa.int64()),
             pa.array(k2, pa.int64()), pa.array(maps, pa.binary()), pa.array(np.arange(node, node + len(rows))),
             pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary()), *b.columns[2:]],
            names=["doc_id", "n", "k1", "k2", "bits", "node", "place", "at", "own", *b.schema.names[2:]])
        yield out
        schema, node = out.schema, node + len(rows)
        if held >= PACK << bits or len(waiting) >= 1 << 15:
            if held:
                yield packed()
            base, waiting, held = node, [], 0
    if held:
        yield packed()


def _task() -> int:
    return TaskContext.get().partitionId()


def _unpacked(batches):
    """Packed buckets ``(place, node, at, own)`` in order of ``place`` as rows ``(at, k1, known)`` in order of ``at``
    and ``k1``, the row's number (``known`` is null)."""
    def ordered(at, node):
        order = np.lexsort((node, at))
        return pa.RecordBatch.from_arrays([pa.array(at[order]), pa.array(node[order]), pa.nulls(len(at), pa.int64())],
                                          names=["at", "k1", "known"])
    at, node = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        count = pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False) // 2
        place, base = (np.repeat(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64), count) for i in (0, 1))
        low, own = (np.frombuffer(b"".join(b.column(i).to_pylist()), kind).astype(np.int64) for i, kind in ((2, "<u4"), (3, "<u2")))
        at, node = np.concatenate([at, place << 32 | low]), np.concatenate([node, base + own])
        # The last place may go on in the next batch.
        if len(at):
            done = int(np.searchsorted(at >> 32, at[-1] >> 32))
            yield ordered(at[:done], node[:done])
            at, node = at[done:], node[done:]
    yield ordered(at, node)


def _bucket_links(batches):
    """Rows ``(at, k1, known)`` in order of ``at`` as links ``(k1, lead)``: the known ones as they are, the others
    to the first of their bucket, which may have come batches before."""
    last, lead = None, None
    for b in batches:
        known = b.column(2)
        linked = b.filter(known.is_valid())
        own = b.filter(known.is_null())
        at, k1 = (own.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        leads = k1[first]
        if len(at):
            if last is not None and at[0] == last:
                leads[0] = lead
            leads = leads[np.cumsum(first) - 1]
            last, lead = at[-1], leads[-1]
        apart = k1 != leads
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([linked.column(1).to_numpy(zero_copy_only=False), k1[apart]])),
             pa.array(np.concatenate([linked.column(2).to_numpy(zero_copy_only=False), leads[apart]]))],
            names=["k1", "lead"])


def _sets(batches, n: int):
    shingles = Shingler(n)
    for b in sliced(batches):
        sets = [shingles(t.as_py()) for t in b.column(1)]
        k1, k2 = zip(*map(_key, sets)) if sets else ([], [])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(k1, pa.int64()),
             pa.array(k2, pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))],
            names=["doc_id", "n", "k1", "k2", "hashes"])


def _bitmap(hashes: np.ndarray) -> bytes:
    """A set's elements by their first bits, in two bits an element or more: a power of two of them."""
    bits = 1 << max(BITS, (2 * len(hashes) - 1).bit_length())
    map_ = np.zeros(bits, np.uint8)
    map_[(hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(map_).tobytes()


def _halved(bits: bytes) -> bytes:
    """The bitmap of the same set with half as many bits."""
    return np.packbits(np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, 2).any(axis=1)).tobytes()


class Tile:
    """Sets in order of size, compared by bitmap."""

    def __init__(self, ids: list[int], size: list[int], bits: list[bytes], left: list[bool] | None, percent: int):
        self.order = sorted(range(len(ids)), key=lambda i: (size[i], ids[i]))
        self.size = np.array([size[i] for i in self.order], np.int64)
        self.side = np.array([left[i] for i in self.order]) if left is not None else None
        self.percent = percent
        maps = [bits[i] for i in self.order]
        widths = np.array([len(m) for m in maps])
        # Linked sets have equal bitmaps' widths, or the larger one twice that of the smaller: it is halved to compare.
        self.maps, self.start = {}, {}
        for width in np.unique(widths):
            at = np.flatnonzero((widths == width) | (widths == 2 * width))
            self.start[width] = at[0]
            self.maps[width] = np.stack([np.frombuffer(maps[i] if widths[i] == width else _halved(maps[i]), np.uint64)
                                         for i in at])
        self.widths = widths

    def admitted(self, i: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sets after ``i`` whose overlap with it may be large enough, and the number of bits they differ in."""
        to = int(np.searchsorted(self.size, self.size[i] * 100 // self.percent, side="right"))
        js = np.arange(i + 1, to)
        if self.side is not None:
            js = js[self.side[js] != self.side[i]]
        if skip is not None:
            js = js[skip[js] != skip[i]]
        if not len(js):
            return js, js
        width = self.widths[i]
        maps, start = self.maps[width], self.start[width]
        apart = np.bitwise_count(maps[js - start] ^ maps[i - start]).sum(axis=1, dtype=np.int64)
        # |A & B| >= p/(100+p) (a+b)  <=>  |A ^ B| <= (100-p)/(100+p) (a+b)
        ok = apart * (100 + self.percent) <= (100 - self.percent) * (self.size[i] + self.size[js])
        return js[ok], apart[ok]


def spanning_links(ids: list[int], sets: list[np.ndarray], left: list[bool] | None = None,
                   percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all linked sets. With ``left``, only pairs of a left with a right set count."""
    tile = Tile(ids, [len(s) for s in sets], [_bitmap(s) for s in sets], left, percent)
    order, size = tile.order, tile.size
    sets = [sets[i] for i in order]
    comp = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        js, apart = tile.admitted(i, comp)
        for j in js[np.argsort(apart, kind="stable")]:
            if comp[j] == comp[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                comp[comp == comp[j]] = comp[i]
                links.append((ids[order[i]], ids[order[j]]))
    return links


COMPARISON = ["grp", "band", "i", "up", "j"]


def _side(left: list[bool]) -> list[bool] | None:
    """The sides of a comparison of two tiles, None for a tile with itself."""
    return None if all(left) or not any(left) else left


def _tile_admitted(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs that connect all rows of a comparison whose bitmaps admit a link."""
    ids = rows["class"].to_pylist()
    tile = Tile(ids, rows["n"].to_pylist(), rows["bits"].to_pylist(), _side(rows["left"].to_pylist()), percent)
    comp, a, b = np.arange(len(rows)), [], []
    for i in range(len(rows)):
        for j in tile.admitted(i, comp)[0]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                a.append(ids[tile.order[i]])
                b.append(ids[tile.order[j]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tile_links(rows: pa.Table, percent: int) -> pa.Table:
    sets = [h.values.to_numpy().view(np.uint64) for h in rows["hashes"]]
    links = spanning_links(rows["class"].to_pylist(), sets, _side(rows["left"].to_pylist()), percent)
    a, b = zip(*links) if links else ([], [])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _band_of(n: Column, percent: int) -> Column:
    """A band number per size; linked sets are in equal or adjacent ones (the
    bands are a little wider than need be, so rounding cannot part a pair)."""
    return F.floor(F.log(n.cast("double")) / F.lit(1.0001 * float(np.log(100 / percent)))).cast("int")


def _gathered(edges: DataFrame) -> DataFrame:
    """``node, grp`` of the sets to compare, out of ``edges(k1, lead)`` that link the sets of a bucket to its first.

    A component that fits a tile is a group. Larger ones are chains of sets that share some bucket with a next one: there the
    sets of each bucket are a group, together with those of the other buckets that have the same first set. A
    set is in at most as many groups as it has buckets, however large its component grows.
    """
    nodes = staged(components(edges, "k1", "lead"), "jaccard-groups")
    large = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > TILE_DOCS).select("comp")
    whole = nodes.join(large, "comp", "left_anti").select("node", F.col("comp").alias("grp"))
    of = edges.join(nodes.join(large, "comp", "left_semi").select(F.col("node").alias("lead")), "lead")
    cut = of.select(F.col("k1").alias("node"), F.col("lead").alias("grp")).unionByName(
        of.select(F.col("lead").alias("node"), F.col("lead").alias("grp")).distinct())
    return staged(whole.unionByName(cut), "jaccard-gathered")


def _tiled(members: DataFrame, percent: int, *carry: str) -> DataFrame:
    """``members(grp, class, n)`` and columns to ``carry``, copied to each comparison of tiles they take part in.

    A group that fits a tile is one comparison. A larger one is cut by
    size band, and each band by a hash of the class; a comparison is a tile with
    itself, with another of its band, or with one of the next band.
    """
    m = members.withColumn("band", _band_of(F.col("n"), percent))
    bands = m.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("hashes_all"))
    # Only sums per group and band are brought together by group.
    whole = bands.groupBy("grp").agg(F.sum("docs").alias("grp_docs"), F.sum("hashes_all").alias("grp_hashes"))
    large = whole.filter((F.col("grp_docs") > TILE_DOCS) | (F.col("grp_hashes") > 4 * TILE_HASHES)).select("grp")
    cuts = staged(bands.join(large, "grp").select("grp", "band", F.greatest(
        F.ceil(F.col("docs") / F.lit(TILE_DOCS)),
        F.ceil(F.col("hashes_all") / F.lit(TILE_HASHES))).cast("int").alias("tiles")), "tile-counts")
    nxt = cuts.select("grp", (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    prev = cuts.select("grp", (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    shape = cuts.join(nxt, ["grp", "band"], "left").join(prev, ["grp", "band"], "left")
    m = m.join(shape, ["grp", "band"], "left").withColumn(
        "tile", F.pmod(F.xxhash64("class"), F.coalesce("tiles", F.lit(1))).cast("int"))

    def pairs(count, make):
        none = F.array().cast("array<struct<band:int,i:int,up:int,j:int,left:boolean>>")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(none)

    def place(band, i, up, j, left):
        return F.struct(band.alias("band"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), left.alias("left"))
    b, t = F.col("band"), F.col("tile")
    own = pairs(F.col("tiles"), lambda j: place(b, F.least(t, j), 0, F.greatest(t, j), t <= j))
    up = pairs(F.col("above"), lambda j: place(b, t, 1, j, F.lit(True)))
    down = pairs(F.col("below"), lambda j: place(b - 1, j, 1, t, F.lit(False)))
    alone = F.array(place(F.lit(0), F.lit(0), 0, F.lit(0), F.lit(True)))
    places = F.when(F.col("tiles").isNull(), alone).otherwise(F.concat(own, up, down))
    return m.select("grp", "class", "n", *carry, F.explode(places).alias("p")).select(
        "grp", "p.band", "p.i", "p.up", "p.j", "p.left", "class", "n", *carry)


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``, and its string columns ``carry``."""
    carry = carry or []
    schema = ("doc_id long, n long, k1 long, k2 long, bits binary, node long, place int, at binary, own binary"
              + "".join(f", {c} string" for c in carry))
    place_bits = min(16, max(PLACE_BITS, (2 * parallelism(docs.sparkSession)).bit_length()))
    written = staged(lean(docs).select("doc_id", "text", *carry)
                     .mapInArrow(lambda bs: _profiles(bs, n, percent, place_bits, _task), schema), "jaccard-profiles")
    profile = written.filter("place is null").drop("place", "at", "own")
    docs = docs.select("doc_id", "text")
    key = ["n", "k1", "k2"]
    classes = staged(profile.filter("n > 0 and doc_id is not null").groupBy(*key)
                     .agg(F.min("doc_id").alias("rep"))
                     .withColumn("class", F.monotonically_increasing_id()), "jaccard-classes")
    candidates = (written.filter("place is not null").select("place", "node", "at", "own")
                  .repartition("place").sortWithinPartitions("place")
                  .mapInArrow(lambda bs: _bucket_links(_unpacked(bs)), "k1 long, lead long"))
    groups = _gathered(staged(candidates.distinct(), "jaccard-candidates"))
    maps = profile.filter("bits is not null").select(*key, "bits", "node").join(groups, "node")
    compared = (classes.join(maps.groupBy(*key, "grp").agg(F.first("bits").alias("bits")), key)
                .select("class", "n", "grp", "bits"))
    likely_links = (_tiled(staged(compared, "jaccard-compared"), percent, "bits").groupBy(*COMPARISON)
                    .applyInArrow(lambda rows: _tile_admitted(rows, percent), "a long, b long"))
    likely_groups = components(likely_links, "a", "b").select(F.col("node").alias("class"), F.col("comp").alias("grp"))
    needed = staged(classes.join(likely_groups, "class").select("class", F.col("rep").alias("doc_id"), *key, "grp"), "jaccard-needed")
    admitted = _tiled(needed.select("grp", "class", "n"), percent).drop("n")
    # Few documents are left: a filter of bounded size keeps most of the others from being hashed and moved.
    likely = maybe_in(docs, id_filter(needed)).filter("maybe").select("doc_id", "text")
    sets = likely.mapInArrow(lambda bs: _sets(bs, n), "doc_id long, n long, k1 long, k2 long, hashes array<long>")
    # An id that is repeated with other texts has other sets too: the key tells which one is meant.
    located = (sets.join(needed, ["doc_id", *key]).dropDuplicates(["doc_id", *key])
               .select("class", "hashes"))
    links = (admitted.join(located, "class").groupBy(*COMPARISON)
             .applyInArrow(lambda rows: _tile_links(rows, percent), "a long, b long"))
    linked = (components(staged(links, "jaccard-links"), "a", "b").withColumnRenamed("node", "class")
              .join(classes.select("class", "rep"), "class"))
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    linked = staged(linked.join(least, "comp").select("class", "least"), "jaccard-linked")
    # Equal sets meet in their class, near ones through links between classes.
    reach = staged(classes.join(linked, "class", "left")
                   .select(*key, F.coalesce("least", "rep").alias("component_id")), "jaccard-reach")
    return (profile.drop("bits", "node").join(reach, key, "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    *carry))
