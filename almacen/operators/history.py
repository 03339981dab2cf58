"""Where a customer buys from, over time: validity intervals, and the join of lines to them.

The customer dimension keeps a customer's first country; lines carry their own.
Between the two lies the history: the country of each day on which a customer
buys (that of the day's first line), and an interval from each day on which it
differs from the one before until the next such day.

Lines are reduced to one row per customer and day before anything is ordered, so
a customer has at most as many rows as the calendar has days, however many
lines. A line finds its interval by an as-of join: intervals and lines lie in one
sorted sequence, dealt by range, and a line takes the last interval begun before
it. No interval is repeated, none is sent to all tasks, and neither a customer's
lines nor the intervals are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import asof_join


def daily_country(fact: DataFrame) -> DataFrame:
    """``cliente_id, fecha_id, geografia_id``: the country of the first line of each customer and day."""
    return fact.groupBy("cliente_id", "fecha_id").agg(
        F.min_by("geografia_id", F.struct("hora_venta", "ventas_id")).alias("geografia_id"))


def country_intervals(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """``cliente_id, version, geografia_id, valid_from, valid_to``: ``valid_to`` is the first day that no longer
    belongs to the interval, NULL in a customer's last one."""
    days = daily_country(fact).join(dates.select("fecha_id", F.col("fecha_completa").alias("day")), "fecha_id")
    order = Window.partitionBy("cliente_id").orderBy("day")             # a customer's days: bounded by the calendar
    changed = days.withColumn("before", F.lag("geografia_id").over(order)).filter(
        ~F.col("geografia_id").eqNullSafe(F.col("before")))
    return changed.select("cliente_id", F.row_number().over(order).alias("version"), "geografia_id",
                          F.col("day").alias("valid_from"), F.lead("day").over(order).alias("valid_to"))


def valid_at(lines: DataFrame, intervals: DataFrame, day: str, last: DataFrame, workdir: str | None = None) -> DataFrame:
    """``lines`` with ``version`` and ``valid_geografia`` of the interval of their customer that holds ``day``.

    A customer's intervals do not overlap, so the last one that began by ``day`` is the only one that may hold it.
    ``last`` is one value, the last day of the calendar: an open interval lasts to the end of its month.
    """
    began = intervals.withColumn(day, F.col("valid_from"))
    found = F.struct("version", F.col("geografia_id").alias("valid_geografia"), "valid_from", "valid_to")
    out = asof_join(lines, began, ["cliente_id"], day, found, "__found",
                    [c for c in lines.columns if c not in ("cliente_id", day)], name="valid-at", workdir=workdir)
    month = F.trunc(F.greatest(last.scalar(), F.col("__found.valid_from")), "month")
    held = F.when(F.col("__found.valid_to").isNull(), F.trunc(day, "month") <= month).otherwise(F.col(day) < F.col("__found.valid_to"))
    return out.select(*lines.columns, F.when(held, F.col("__found.version")).alias("version"),
                      F.when(held, F.col("__found.valid_geografia")).alias("valid_geografia"))
