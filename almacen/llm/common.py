"""Small helpers shared by the operators: table access, written stages, graph components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, write_table

#: White space as the word contracts define it: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage,
    fixes generated ids, and lets a lost executor cost only its running stage."""
    return write_table(df, scratch_path(df.sparkSession, f"llm-{name}"))


#: Bytes of an Arrow batch between Spark and a Python worker. Spark's 64 MB are held twice in its native memory
#: and once or twice in the worker, by every running task.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded by ``BATCH_BYTES``: the setting is lowered, never raised.

    It is read when a plan runs, so it stays lowered. Results do not depend on it.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(BATCH_SETTING).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".find(unit or " ") > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


#: Rows that a task turns into Python objects at a time, however short they are.
SLICE = 1_000


def sliced(batches, rows: int = SLICE):
    """Arrow batches in slices of ``rows``, so that what a task makes of them at a time stays small."""
    for b in batches:
        for start in range(0, max(1, b.num_rows), rows):
            yield b.slice(start, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII, much faster than ``translate``."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets it as a lambda
    variable, so the optimizer cannot copy the expression into an inner loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of an id filter: at most 128 KB of bits (16,384 rows) are broadcast, whatever the input.
FILTER_BITS = 1 << 20


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap of the hashed ``doc_id`` as rows ``(w, b)`` of 64 bits, ``FILTER_BITS / 64`` at most."""
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("h"))
    return (at.select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")))


def maybe_in(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """``docs`` with a flag ``maybe``: false means that the row's id is surely not in the filter."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    h = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    f = F.broadcast(bits.select(F.col("w").alias("__w"), F.col("b").alias("__b")))
    return (docs.withColumn("__h", h).join(f, F.expr("__h div 64 = __w"), "left")
            .select(*names, F.coalesce(F.expr("(__b & shiftleft(1L, cast(__h % 64 as int))) <> 0"),
                                       F.lit(False)).alias("maybe")))


def text_digest(text: Column) -> Column:
    """The digest of a normalised text (A-Z lower-cased, null as empty), as ``exact_dedup`` gives it."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text are in ``dropped(doc_id, text_sha256)``.

    A verdict belongs to an id and a text: other texts of a null or repeated id stay.
    Only rows that the filter of dropped ids may hold are joined; the others
    pass where they lie, so a few dropped rows do not move all texts. With
    very many dropped rows it becomes a plain anti join.
    """
    gone = staged(dropped.select("doc_id", "text_sha256").distinct(), "dropped")
    split = maybe_in(docs, id_filter(gone))
    g = gone.select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__digest"))
    doubtful = split.filter("maybe").join(g, F.col("doc_id").eqNullSafe(F.col("__gone"))
                                          & (text_digest(F.col("text")) == F.col("__digest")), "left_anti")
    return split.filter("not maybe").drop("maybe").unionByName(doubtful.drop("maybe"))


#: Rows of two ids in a task of a written table of a graph: a few MB.
ROWS_A_TASK = 1 << 18


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` narrow rows at most, in no more tasks than these fill. A small table
    would else take a task and a file per shuffle partition, however many a cluster has."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph as ``(node, comp)``, ``comp``
    being the smallest node; only nodes with an edge appear.

    Each round hooks every node to its smallest neighbour, follows the hooks
    to a root (pointer jumping), and keeps the edges between different roots.
    Every root left with an edge merges with another one, so the number of
    roots at least halves per round. Everything is joins and partial
    aggregates on written tables, in tasks by the number of edges left; only row counts reach the driver.
    """
    e = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
               .filter("a <> b").distinct(), "cc-edges")
    labels = None
    while rows := e.count():
        nodes = 2 * rows
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(packed(both.groupBy(F.col("a").alias("node"))
                             .agg(F.least(F.min("b"), F.col("node")).alias("up")), nodes), "cc-hook")
        while True:
            # up(up(x)): hooks always point to smaller nodes, so this ends at a root
            jumped = staged(packed(hook.alias("h").join(
                hook.select(F.col("node").alias("n2"), F.col("up").alias("u2")).alias("g"),
                F.col("h.up") == F.col("g.n2")).select("node", F.col("u2").alias("up"),
                                                       (F.col("u2") != F.col("up")).alias("moved")), nodes),
                "cc-jump")
            hook = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels, labelled = hook.select("node", F.col("up").alias("comp")), nodes
        else:
            labels = staged(packed(labels.join(hook.select(F.col("node").alias("comp"), "up"), "comp", "left")
                                   .select("node", F.coalesce("up", "comp").alias("comp")), labelled), "cc-labels")
        ha = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        hb = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e = staged(packed(e.join(ha, "a").join(hb, "b").filter("ra <> rb")
                          .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), rows), "cc-edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
