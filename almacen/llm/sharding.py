"""7. Two-pass external shuffle into shards (native: SQL functions only).

Pass one scatters the records into buckets by a seeded hash of key and text;
the bucket count follows from the bytes and rows, so a bucket fits a task's
memory at any input size. Records that repeat a key and text too often for that
(a null key of a third of all rows, say) are scattered by a written row number as well. Pass two puts each bucket into key order and
permutes it with Spark's ``shuffle`` (a Fisher-Yates shuffle with a seed).
The buckets in a row are then one uniformly shuffled sequence; record ``g``
of it goes to shard ``g mod shards``, slot ``g div shards``, so shard sizes
differ by one record at most. Buckets are dealt to partitions of a few of them, on large inputs
of ``TASK_BYTES``, and sorted there, so that the permutation depends on the
records and the seed, not on the session, and a task's share does not grow.

Defined cases: a null text has no bytes; rows repeating a key stay apart as
rows; a null key is a key; an empty table gives no row; further columns travel
along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism
from .common import staged

BUCKET_BYTES, BUCKET_ROWS, BUCKETS_A_TASK, SUPER = 4 << 20, 20_000, 4, 1024
#: Of a partition on large inputs: 100 TB make 400,000 of them.
TASK_BYTES = 256 << 20


def partitions(buckets: int, size: int, parallel: int) -> int:
    """A few buckets each, but no more partitions than the session asks for or ``TASK_BYTES`` gives."""
    return max(1, min(math.ceil(buckets / BUCKETS_A_TASK), max(parallel, math.ceil(size / TASK_BYTES))))


def _offsets(counts: DataFrame) -> DataFrame:
    """Exclusive prefix sums of ``(bucket, n)``, in two steps: within runs of
    ``SUPER`` buckets in parallel, then over one row per run."""
    runs = counts.withColumn("run", F.expr(f"bucket div {SUPER}"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.groupBy("run").agg(F.sum("n").alias("n")).select(
        "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (runs.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
            .join(heads, "run").select("bucket", (F.col("head") + F.col("inner")).alias("offset")))


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 20, key: str = "doc_id",
                     bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``docs`` (with ``text``) plus ``shard`` and ``slot``."""
    columns, text_hash = docs.columns, F.xxhash64("text")
    # Written once, so that a row's number is a fact however often a task is run.
    rec = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("rec"), F.col(key).alias("k"),
                             text_hash.alias("t"), F.octet_length("text").cast("long").alias("size"),
                             F.monotonically_increasing_id().alias("row")), "sharding-records")
    rows, size = rec.agg(F.count(F.lit(1)), F.sum("size")).first()
    buckets = max(1, math.ceil((size or 0) / bucket_bytes), math.ceil(rows / bucket_rows))
    # Groups of equal keys and texts that would fill a quarter of a bucket by themselves: rows / bucket_rows * 4 at most.
    many = (F.count(F.lit(1)) * 4 > bucket_rows) | (F.sum("size") * 4 > bucket_bytes) & (F.count(F.lit(1)) > 1)
    hot = staged(rec.groupBy("k", "t").agg(many.alias("many")).filter("many").select(F.col("k").alias("hk"), F.col("t").alias("ht")),
                 "sharding-hot")
    salted = (rec.join(hot, F.col("k").eqNullSafe(F.col("hk")) & F.col("t").eqNullSafe(F.col("ht")), "left")
              .withColumn("salt", F.when(F.col("ht").isNotNull(), F.col("row"))).drop("hk", "ht")
              if not hot.isEmpty() else rec.withColumn("salt", F.lit(None).cast("long")))
    bucketed = salted.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k", "t", F.coalesce("salt", F.lit(-1))), F.lit(buckets)))
    offsets = _offsets(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    record = F.struct("k", "t", "row", "rec")

    def by_key(a, b):
        def cmp(x, y):
            return (F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1)
                    .when(x < y, -1).otherwise(1))
        return (F.when(~a["k"].eqNullSafe(b["k"]), cmp(a["k"], b["k"]))
                .when(~a["t"].eqNullSafe(b["t"]), cmp(a["t"], b["t"])).otherwise(cmp(a["row"], b["row"])))
    filled = (bucketed.select("bucket", record.alias("r"))
              .repartition(partitions(buckets, size or 0, parallelism(docs.sparkSession)), "bucket")
              .groupBy("bucket").agg(F.collect_list("r").alias("rs"))
              .sortWithinPartitions("bucket")
              .select("bucket", F.shuffle(F.array_sort("rs", by_key), F.lit(seed)).alias("rs")))
    placed = filled.join(offsets, "bucket").select("offset", F.posexplode("rs").alias("pos", "r"))
    g = F.col("offset") + F.col("pos")
    return placed.select("r.rec.*", F.pmod(g, F.lit(shards)).cast("int").alias("shard"),
                         F.expr(f"(offset + pos) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20) -> None:
    """Write the shuffled records as one folder per shard, each file in slot order."""
    out = external_shuffle(docs, shards, seed)
    (out.repartitionByRange(max(shards, parallelism(docs.sparkSession)), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
