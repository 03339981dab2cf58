"""Order-dependent operators that scale past one task, and size-checked joins.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one
partition. That is fine over months or hours, but not over customers,
products or fact lines. These helpers compute the same values in parallel:

1. range-partition the rows on the ordering (Spark samples the bounds; AQE
   sizes the partitions) and sort inside each partition;
2. tag every row with its partition id and its position inside the
   partition (``monotonically_increasing_id`` is ``pid << 33 | position``);
3. write that tagged table to shared storage, so the ids are fixed facts
   and not recomputed (executor loss cannot reshuffle them);
4. aggregate per partition (count, sum) - one row per partition - and turn
   those into prefix offsets with a window over at most ``n`` rows;
5. broadcast the offsets (size bound: the partition count) and add them.

``row_number``, running sums and ``ntile`` cuts all follow from this.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DENSE, parallelism, scratch_path, write_table

_PID = "__pid"
_POS = "__pos"
_OFF = "__off"


def _order_cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: list, num_partitions: int | None, name: str,
            materialize_input: bool = False, workdir: str | None = None, leave: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    if materialize_input:
        # Range partitioning samples its input, then shuffles it: two passes.
        # With AQE an aggregate below is already its own materialized query
        # stage, so both passes read its shuffle output; writing the input
        # first only pays off for an expensive plan without such a boundary.
        df = write_table(df, scratch_path(spark, f"input-{name}", workdir), codec=DENSE)
    cols = _order_cols(order)
    # Without an explicit count, AQE coalesces adjacent ranges to its
    # advisory partition size; coalesced partitions stay contiguous and in
    # order, so partition ids still follow the global order.
    ranged = (df.repartitionByRange(num_partitions, *cols) if num_partitions
              else df.repartitionByRange(*cols))
    tagged = (ranged
              .sortWithinPartitions(*cols)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_POS, F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .drop(*(leave or [])))
    return write_table(tagged, scratch_path(spark, f"ranked-{name}", workdir), codec=DENSE)


def _prefix(per_part: DataFrame, value: str, out: str) -> DataFrame:
    """Exclusive prefix sum over partition ids (at most n rows, one task)."""
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(_PID, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def with_row_number(df: DataFrame, order: list, name: str = "rn",
                    num_partitions: int | None = None,
                    materialize_input: bool = False,
                    total_name: str | None = None,
                    workdir: str | None = None, leave: list[str] | None = None) -> DataFrame:
    """Add a gapless 1..n ``name`` following ``order`` (must be a total order).

    ``total_name`` also adds the row count n (taken from the per-partition
    counts, so it costs no extra pass). Columns to ``leave`` serve the order
    alone and are not in the result.
    """
    staged = _ranged(df, order, num_partitions, name, materialize_input, workdir, leave)
    counts = staged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = _prefix(counts, "__cnt", _OFF)
    if total_name:
        offsets = offsets.join(counts.select(_PID, F.sum("__cnt").over(Window.partitionBy())
                                             .alias(total_name)), _PID)
    return (staged.join(F.broadcast(offsets), _PID)
            .withColumn(name, (F.col(_OFF) + F.col(_POS) + 1).cast("long"))
            .drop(_PID, _POS, _OFF))


def with_running_sum(df: DataFrame, order: list, value: str, name: str,
                     rn_name: str | None = None, total_name: str | None = None,
                     num_partitions: int | None = None,
                     workdir: str | None = None) -> DataFrame:
    """Add the inclusive running sum of ``value`` along ``order`` (a total order).

    ``total_name`` also adds the sum over all rows, from the same per-range sums.

    The in-partition cumulative sum is a window partitioned by the range
    partition id, so it runs in parallel, one range per task.
    """
    staged = _ranged(df, order, num_partitions, name, workdir=workdir)
    sums = staged.groupBy(_PID).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__cnt"))
    offsets = _prefix(sums, "__sum", _OFF).join(_prefix(sums, "__cnt", "__offn"), _PID)
    if total_name:
        offsets = offsets.join(sums.select(_PID, F.sum("__sum").over(Window.partitionBy())
                                           .alias(total_name)), _PID)
    local = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    out = (staged.join(F.broadcast(offsets), _PID)
           .withColumn(name, F.col(_OFF) + F.sum(value).over(local)))
    if rn_name:
        out = out.withColumn(rn_name, (F.col("__offn") + F.col(_POS) + 1).cast("long"))
    return out.drop(_PID, _POS, _OFF, "__offn")


def ntile_of(rn: Column, n: Column, buckets: int) -> Column:
    """SQL NTILE(buckets) from a 1-based row number and the row count.

    The first ``n % buckets`` tiles get one extra row, as in SQL.
    """
    q = F.floor(n / buckets)
    m = n - q * buckets
    big = m * (q + 1)
    return F.when(rn <= big, F.ceil(rn / (q + 1))).otherwise(
        m + F.ceil((rn - big) / q)).cast("long")


def ntile_cuts(df: DataFrame, order: list, buckets: int, workdir: str | None = None) -> list:
    """The first row of each NTILE(buckets) but the first over ``order`` (a total
    order): ``buckets - 1`` rows at most reach the driver, fewer if tiles are empty."""
    numbered = with_row_number(df, order, "__rn", total_name="__n", workdir=workdir)
    before = ntile_of(F.col("__rn") - 1, F.col("__n"), buckets)
    first = numbered.filter((F.col("__rn") > 1) & (ntile_of(F.col("__rn"), F.col("__n"), buckets) != before))
    return first.orderBy("__rn").drop("__rn", "__n").collect()


# --- joins -------------------------------------------------------------------


_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    """Spark size string ('10485760b', '10MB', '1g', '-1') -> bytes (-1: disabled)."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)(?:i?b)?\s*", str(text).lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def max_broadcast_bytes(spark) -> int:
    """The session's broadcast threshold; -1 where broadcasting is off."""
    return _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b"))


#: A look-up reads two narrow columns of a dimension. So much of them is sent to every task even under a lower threshold:
#: the other way moves all lines, whole.
LOOKUP_BYTES = 64 << 20


def lookup_budget(spark) -> int:
    """Bytes of a dimension's keys up to which they are broadcast; -1 where broadcasting is off."""
    threshold = max_broadcast_bytes(spark)
    return threshold if threshold < 0 else max(threshold, LOOKUP_BYTES)


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of all rows: their text as it is, 16 bytes per value and row beside it."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = F.lit(16 * (len(df.columns) + 1))
    for t in text:
        row = row + t
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


HOT_SAMPLE_FRACTION = 0.01
HOT_SAMPLE_SEED = 17


def key_sample(facts: DataFrame, keys: list[str], workdir: str | None = None) -> DataFrame:
    """A written 1% sample of the join-key columns of ``facts``.

    Taken once before a chain of joins, it lets every join find its hot keys
    without re-running the joins before it.
    """
    spark = facts.sparkSession
    sample = facts.select(*keys).sample(fraction=HOT_SAMPLE_FRACTION, seed=HOT_SAMPLE_SEED)
    return write_table(sample, scratch_path(spark, "key-sample", workdir))


def hot_keys(facts: DataFrame, key: str, parts: int, sampled: bool = False) -> DataFrame:
    """Keys holding at least 1/(4*parts) of the rows, found on a 1% sample.

    Returns ``__hk`` and ``__salts`` = ceil(share * parts): a key with a third
    of the rows is spread over a third of the partitions. At most 4*parts
    keys pass and the salts sum to at most 5*parts, so the result and the
    dimension rows it replicates are a bounded broadcast. Which keys count as
    hot only steers the join strategy, never its result, so a sampled answer
    is safe.
    """
    sample = facts.select(F.col(key).alias("__hk"))
    if not sampled:
        sample = sample.sample(fraction=HOT_SAMPLE_FRACTION, seed=HOT_SAMPLE_SEED)
    counts = sample.groupBy("__hk").agg(F.count(F.lit(1)).alias("__n"))
    total = F.greatest(sample.agg(F.count(F.lit(1))).scalar(), F.lit(4 * parts))
    return (counts.filter(F.col("__n") * (4 * parts) >= total)
            .select("__hk", F.ceil(F.col("__n") * parts / total).cast("int").alias("__salts")))


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, dim_bytes: int,
                null_safe: bool = False, how: str = "left", sample: DataFrame | None = None,
                workdir: str | None = None) -> DataFrame:
    """Join facts to a dimension whose key is unique.

    * dimension small enough (its measured size against the broadcast
      threshold): broadcast hash join, no shuffle of the facts;
    * otherwise a shuffle join, salted for hot keys: fact rows of a hot key
      get a salt in [0, S) from a hash of the row (S proportional to the
      key's share), the dimension row of a hot key is repeated S times, and
      the join runs on (key, salt). A key holding a third of the facts is
      spread over a third of the tasks; the facts are read once.

    ``sample`` (from :func:`key_sample`) supplies the key sample when
    ``facts`` is itself the output of earlier joins.
    """
    spark = facts.sparkSession

    def _eq(a, b):
        return a.eqNullSafe(b) if null_safe else a == b

    if dim_bytes <= lookup_budget(spark):
        d = F.broadcast(dim)
        return facts.join(d, _eq(facts[fact_key], d[dim_key]), how)

    hot = (hot_keys(sample, fact_key, parallelism(spark), sampled=True) if sample is not None
           else hot_keys(facts, fact_key, parallelism(spark)))
    hot = write_table(hot, scratch_path(spark, "hot-keys", workdir))
    hot_b = F.broadcast(hot)                       # at most 4n rows
    salted_facts = (facts.join(hot_b, facts[fact_key].eqNullSafe(hot_b["__hk"]), "left")
                    .withColumn("__salt", F.when(F.col("__salts").isNotNull(),
                                                 F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]),
                                                        F.col("__salts")))
                                .otherwise(F.lit(0)).cast("int"))
                    .drop("__hk", "__salts"))
    hot_d = F.broadcast(hot)
    salted_dim = (dim.join(hot_d, dim[dim_key].eqNullSafe(hot_d["__hk"]), "left")
                  .withColumn("__dsalt", F.explode(
                      F.when(F.col("__salts").isNotNull(), F.sequence(F.lit(0), F.col("__salts") - 1))
                      .otherwise(F.array(F.lit(0)))))
                  .drop("__hk", "__salts"))
    cond = _eq(salted_facts[fact_key], salted_dim[dim_key]) & (
        salted_facts["__salt"] == salted_dim["__dsalt"])
    return salted_facts.join(salted_dim, cond, how).drop("__salt", "__dsalt")
