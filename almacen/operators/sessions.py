"""Purchase sessions: a customer's orders with no gap of more than some days between them.

The time before each order is the running last value of its customer, so a
customer with a third of all orders is cut into ranges like any other (see
:mod:`segments`); a gap that is too long begins a session, and the running number of
beginnings names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, write_table
from .segments import Segments


def sessions(orders: DataFrame, gap_hours: int, workdir: str | None = None) -> DataFrame:
    """``customer, session, orders, first_at, last_at`` of ``orders(customer, invoice, at)``, ``at`` in whole hours.

    Orders without a time belong to no session; of orders at one time all belong to the same.
    """
    spark = orders.sparkSession
    rows = orders.filter("at is not null").select("customer", "at", "invoice").distinct()
    seg = Segments(rows, ["customer"], ["at", "invoice"], "sessions", workdir)
    before = write_table(seg.scan(seg.rows, "before", "last", F.col("at"), before=True),
                         scratch_path(spark, "sessions-before", workdir))
    begins = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") > gap_hours), 1).otherwise(0)
    named = seg.scan(before, "session", "sum", begins)
    return named.groupBy("customer", "session").agg(
        F.count(F.lit(1)).alias("orders"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
