"""Stored daily summaries that answer any range of dates by merging.

Distinct customers and orders cannot be added up over days, nor can medians. A
day's HyperLogLog and quantile (KLL) sketches can: they are a few kilobytes whatever the
day's lines, so a range of years reads as many small rows as it has days instead of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the HyperLogLog buckets (relative error about 1 %) and size of the quantile sketch (rank error about 1 %).
LG_K, KLL_K = 14, 400


def daily(fact: DataFrame, known: Column) -> DataFrame:
    """One row per date: ``customers, orders, prices`` as sketches, and the exact number of lines."""
    sold = F.col("is_cancelled") == 0
    return fact.groupBy("fecha_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.hll_sketch_agg(F.when(sold & known, F.col("cliente_id")), LG_K).alias("customers"),
        F.hll_sketch_agg(F.when(sold, F.col("invoice_number")), LG_K).alias("orders"),
        F.kll_sketch_agg_double(F.when(sold, F.col("precio_unitario").cast("double")), KLL_K).alias("prices"))


def merged(days: DataFrame, *by: str) -> DataFrame:
    """The estimates over the given days, per group: ``lines, customers, orders, median_price`` and the
    merged quantile sketch."""
    m = days.groupBy(*by).agg(
        F.sum("lines").alias("lines"), F.hll_union_agg("customers").alias("c"), F.hll_union_agg("orders").alias("o"),
        F.kll_merge_agg_double("prices").alias("prices"))
    return m.select(*by, "lines", F.hll_sketch_estimate("c").alias("customers"), F.hll_sketch_estimate("o").alias("orders"),
                    F.kll_sketch_get_quantile_double("prices", F.lit(0.5)).alias("median_price"), "prices")
