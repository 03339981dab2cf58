"""13. Approximate nearest neighbours by cosine: a vantage-point tree per shard.

Vectors are compared by the chord of their directions, ``sqrt(2 - 2 cos)``, a
metric that orders as the cosine does. A node of a tree has a vantage point and
two halves, the near and the far rows; with the range of their distances to the
vantage point, the triangle inequality says how near a row of a half can be to
a query. A half is left out if that is beyond ``factor`` times the distance of
the worst neighbour found so far: factor 1 gives exact results, smaller ones
look at fewer rows.

1. Equal vectors are one class, of which the ``k + 1`` smallest ids are kept:
   a query never needs more of them. A vector that many rows share is one row
   from here on, both as a candidate and as a query.
2. A tree over a hashed sample of ``SAMPLE`` classes cuts space into at most
   ``SAMPLE / PER_LEAF`` leaves. All classes are dealt to the leaves, and a
   leaf's classes by hash to shards of about ``SHARD_ROWS``.
3. Every query searches its own leaf. Its worst neighbour there tells which
   other leaves the same pruning admits; these it searches in a second round.
   A shard meets the queries in blocks of about ``QUERY_BLOCK``; each task
   builds the shard's tree and answers one block, so its memory is bounded.
4. The best classes of all shards are expanded to rows and ranked.

Shards take part whole: nothing is capped, and only pruning skips rows. The
score is the dot product over the product of norms in double precision, summed
in the same way for every pair, so equal vectors tie exactly.

Defined cases: rows whose vector is null, all zero or holds a null or
non-finite component take no part, nor do rows without a ``vec_id`` and vectors
of another length than the commonest one (between lengths there is no cosine;
of equally common lengths the greater counts). Of rows that repeat a ``vec_id``
the one with the least vector stays. With fewer than ``k`` candidates all are
returned, with none the query has no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K, FACTOR, QUERY_STEP = 5, 0.18, 50
SAMPLE, PER_LEAF, SHARD_ROWS, QUERY_BLOCK, LEAF = 16_384, 16, 8_192, 8_192, 64
#: Above the rounding of distances of unit vectors, far below any that matters.
EPS = 1e-7


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and norms summed as the scores are. Scaled first, so that squares neither vanish nor overflow."""
    big = np.abs(v).max(axis=1, keepdims=True)
    s = v / big
    return s / np.sqrt((s * s).sum(axis=1, keepdims=True)), np.sqrt((v * v).sum(axis=1))


def _chord(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ p)))


class VantageTree:
    """A balanced tree over the rows of ``unit``; leaves hold ``leaf`` rows at most."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf, self.order, self.nodes = unit, leaf, np.arange(len(unit)), []
        self.root = self._grow(0, len(unit))

    def _vantage(self, rows: np.ndarray) -> int:
        """Of eight rows the one whose distances to others differ most."""
        some = self.unit[rows[:: max(1, len(rows) // 128)]]
        tried = rows[:: max(1, len(rows) // 8)][:8]
        return int(tried[np.argmax([_chord(some, self.unit[p]).std() for p in tried])])

    def _grow(self, start: int, end: int) -> int:
        if end - start <= self.leaf:
            self.nodes.append((start, end))
            return len(self.nodes) - 1
        rows = self.order[start:end]
        p = self._vantage(rows)
        d = _chord(self.unit[rows], self.unit[p])
        half = (end - start) // 2
        by = np.argpartition(d, half)
        self.order[start:end], d = rows[by], d[by]
        near, far = d[:half], d[half:]
        ranges = (near.min(), near.max(), far.min(), far.max())
        inside, outside = self._grow(start, start + half), self._grow(start + half, end)
        self.nodes.append((p, ranges, inside, outside))
        return len(self.nodes) - 1


class Search:
    """The ``k`` best rows of a tree for each of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, leaf: int = LEAF):
        self.ids, self.vectors, self.k, self.factor = ids, vectors, k, factor
        self.unit, self.norms = _unit(vectors)
        self.tree = VantageTree(self.unit, leaf)

    def __call__(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, ``len(queries) x k``, best first; a score of minus infinity stands for none. ``bound`` is a score
        that ``k`` rows known elsewhere reach (minus infinity if there are none)."""
        n = len(queries)
        self.q, self.bound = queries, bound
        self.qu, self.qn = _unit(queries)
        self.best = np.full((n, self.k), -np.inf)
        self.who = np.full((n, self.k), -1, np.int64)
        self.home = np.full(n, -1)
        every = np.arange(n)
        self._descend(self.tree.root, every)
        self._walk(self.tree.root, every)
        return self.who, self.best

    def _radius(self, qs: np.ndarray) -> np.ndarray:
        worst = np.maximum(self.best[qs, -1], self.bound[qs])
        return self.factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst)) + EPS

    def _descend(self, node: int, qs: np.ndarray) -> None:
        """Every query scans the leaf it would lie in, for a first radius."""
        at = self.tree.nodes[node]
        if len(at) == 2:
            self.home[qs] = node
            self._scan(at, qs)
            return
        p, (_, near, far, _), inside, outside = at
        within = _chord(self.qu[qs], self.unit[p]) <= (near + far) / 2
        for child, some in ((inside, qs[within]), (outside, qs[~within])):
            if len(some):
                self._descend(child, some)

    def _walk(self, node: int, qs: np.ndarray) -> None:
        at = self.tree.nodes[node]
        if len(at) == 2:
            self._scan(at, qs[self.home[qs] != node])
            return
        p, (a, b, c, d), inside, outside = at
        dist = _chord(self.qu[qs], self.unit[p])
        for child, low, high in ((inside, a, b), (outside, c, d)):
            r = self._radius(qs)
            some = qs[(dist >= low - r) & (dist <= high + r)]
            if len(some):
                self._walk(child, some)

    def _scan(self, leaf: tuple[int, int], qs: np.ndarray) -> None:
        rows = self.tree.order[leaf[0]:leaf[1]]
        if not len(qs) or not len(rows):
            return
        near = self.qu[qs] @ self.unit[rows].T
        least = np.maximum(self.best[qs, -1], self.bound[qs])
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
        qi, ri = np.nonzero(near >= least[:, None] - EPS)
        if not len(qi):
            return
        q, r = qs[qi], rows[ri]
        with np.errstate(all="ignore"):
            score = (self.q[q] * self.vectors[r]).sum(axis=1) / (self.qn[q] * self.norms[r])
        score = np.where(np.isfinite(score), score, near[qi, ri])      # squares beyond a double's range
        who = np.unique(q)
        q = np.concatenate([np.repeat(who, self.k), q])
        score = np.concatenate([self.best[who].ravel(), score])
        ids = np.concatenate([self.who[who].ravel(), self.ids[r]])
        o = np.lexsort((ids, -score, q))
        take = o[np.searchsorted(q[o], who)[:, None] + np.arange(self.k)]
        self.best[who], self.who[who] = score[take], ids[take]


class Space:
    """The tree over the sample: nodes ``(vantage direction, boundary, near, far)``, leaves numbered."""

    def __init__(self, vectors: np.ndarray, leaves: int):
        self.nodes, self.leaves = [], 0
        unit = _unit(vectors)[0] if len(vectors) else vectors
        tree = VantageTree(unit, max(1, -(-len(unit) // max(1, leaves))))
        self.root = self._copy(tree, tree.root)

    def _copy(self, tree: VantageTree, node: int) -> int:
        at = tree.nodes[node]
        if len(at) == 2:
            self.nodes.append(self.leaves)
            self.leaves += 1
        else:
            p, (_, near, far, _), inside, outside = at
            self.nodes.append((tree.unit[p], (near + far) / 2, self._copy(tree, inside), self._copy(tree, outside)))
        return len(self.nodes) - 1

    def route(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), np.int64)
        todo = [(self.root, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            at = self.nodes[node]
            if isinstance(at, int):
                out[rows] = at
                continue
            p, cut, near, far = at
            within = _chord(unit[rows], p) <= cut
            todo += [(near, rows[within]), (far, rows[~within])]
        return out

    def reach(self, unit: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, leaf)`` for the leaves that may hold a row within a query's radius."""
        q, leaf = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(self.root, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            at = self.nodes[node]
            if isinstance(at, int):
                q.append(rows)
                leaf.append(np.full(len(rows), at))
                continue
            p, cut, near, far = at
            d = _chord(unit[rows], p)
            todo += [(near, rows[d - radius[rows] <= cut + EPS]), (far, rows[d + radius[rows] >= cut - EPS])]
        return np.concatenate(q), np.concatenate(leaf)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _routed(batches, space: Space):
    """Adds to rows ``(cid, vec, ...)`` the leaf they lie in."""
    for b in batches:
        leaf = space.route(_unit(_matrix(b.column("vec")))[0]) if len(b) else []
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "leaf"])


def _reached(batches, space: Space, factor: float):
    """Rows ``(cid, vec, home, bound)`` once for each further leaf that their radius admits."""
    for b in batches:
        if not len(b):
            continue
        bound = b.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
        bound = np.where(np.isnan(bound), -np.inf, bound)
        radius = np.where(np.isinf(bound), np.inf, factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(bound, -1))))
        q, leaf = space.reach(_unit(_matrix(b.column("vec")))[0], radius)
        other = leaf != b.column("home").to_numpy(zero_copy_only=False)[q]
        q, leaf = pa.array(q[other]), leaf[other]
        yield pa.RecordBatch.from_arrays([b.column("cid").take(q), b.column("vec").take(q), pa.array(bound).take(q),
                                          pa.array(leaf, pa.int64())], names=["cid", "vec", "bound", "leaf"])


def _answers(shard: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    names = ["query", "cid", "score"]
    if not len(shard) or not len(queries):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    shard = shard.sort_by("cid")
    search = Search(shard["cid"].to_numpy(), _matrix(shard["vec"]), k, factor)
    bound = queries["bound"].to_numpy().astype(np.float64)
    ids, scores = search(_matrix(queries["vec"]), np.where(np.isnan(bound), -np.inf, bound))
    found = np.isfinite(scores.ravel())
    query = np.repeat(queries["cid"].to_numpy(), k)
    return pa.table([pa.array(query[found]), pa.array(ids.ravel()[found]), pa.array(scores.ravel()[found])], names=names)


def finite(vector: Column) -> Column:
    """Neither null nor empty, every component a finite number."""
    return (vector.isNotNull() & (F.size(vector) > 0)
            & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def common_length(vectors: DataFrame, column: str, step: int = 1) -> int:
    """The commonest length of ``column`` that is a multiple of ``step``, the greatest of several; 0 without rows."""
    sizes = vectors.groupBy(F.size(column).alias("size")).count().filter(f"size > 0 and size % {step} = 0")
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("cid"))
    return found.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")


def _asked(shards: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, factor: float, name: str) -> DataFrame:
    """The ``k`` best classes ``query, cid, score`` of every shard for the ``queries(cid, vec, bound, leaf)`` of its leaf."""
    blocks = queries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    plan = staged(sizes.join(blocks, "leaf"), f"ann-plan-{name}")
    left = (shards.join(plan.select("leaf", "blocks"), "leaf")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("leaf", "sub", "block", "cid", "vec"))
    right = (queries.join(plan, "leaf")
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
             .select("leaf", "sub", "block", "cid", "vec", "bound"))
    key = ["leaf", "sub", "block"]
    answers = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        lambda s, q: _answers(s, q, k, factor), "query long, cid long, score double")
    return staged(_best(answers, k).select("query", "cid", "score"), f"ann-best-{name}")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of the rows of ``vectors(vec_id, embedding)``
    for which ``is_query`` (on ``vec_id``) holds."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    vec = F.col("embedding").cast("array<double>")
    kept = (vectors.select("vec_id", vec.alias("vec")).filter(F.col("vec_id").isNotNull() & finite(F.col("vec")))
            .filter(F.exists("vec", lambda x: x != 0)))
    dims = common_length(kept, "vec")
    rows = staged(kept.filter(F.size("vec") == dims).groupBy("vec_id").agg(F.min("vec").alias("vec")), "ann-rows")
    first = Window.partitionBy("vec").orderBy("vec_id")
    classes = staged(rows.withColumn("at", F.row_number().over(first)).filter(f"at <= {k + 1}")
                     .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .select(F.col("ids")[0].alias("cid"), "vec", "ids"), "ann-classes")
    asked = staged(rows.filter(is_query).join(classes.select("cid", "vec"), "vec").select("vec_id", "cid"), "ann-asked")

    total = classes.count()
    sample = (classes.filter(F.pmod(F.xxhash64("cid"), F.lit(max(1, total))) < SAMPLE)
              .select("cid", "vec").toArrow().sort_by("cid"))
    leaves = min(-(-total // SHARD_ROWS), SAMPLE // PER_LEAF)
    space = Space(_matrix(sample["vec"]), leaves)
    shape = "cid long, vec array<double>, leaf long"
    routed = classes.select("cid", "vec").mapInArrow(lambda bs: _routed(bs, space), shape)
    routed = staged(routed, "ann-routed")
    sizes = staged(routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias("subs")),
                   "ann-sizes")
    shards = routed.join(sizes, "leaf").withColumn("sub", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("subs")).cast("int"))

    queries = staged(routed.join(asked.select("cid").distinct(), "cid"), "ann-queries")
    # One more than k: a query finds itself.
    at_home = _asked(shards, queries.withColumn("bound", F.lit(None).cast("double")), sizes, k + 1, factor, "home")
    bounds = at_home.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("bound"))
    further = staged(queries.join(bounds, queries["cid"] == bounds["query"], "left")
                     .select("cid", "vec", F.col("leaf").alias("home"), "bound")
                     .mapInArrow(lambda bs: _reached(bs, space, factor),
                                 "cid long, vec array<double>, bound double, leaf long"), "ann-further")
    elsewhere = _asked(shards, further, sizes, k + 1, factor, "further")

    found = (_best(at_home.unionByName(elsewhere), k + 1).select("query", "cid", "score")
             .join(classes.select("cid", "ids"), "cid")
             .select("query", "score", F.explode("ids").alias("cid")))
    best = staged(_best(found, k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("cid").alias("vec_id"), "score"))).alias("best")), "ann-found")
    return (asked.join(best, asked["cid"] == best["query"])
            .select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(
                F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k)).alias("pos", "one"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), "one.score"))
