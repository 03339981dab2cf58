"""Who comes back: cohorts by month bitmaps, and rolling active customers by a sweep.

A customer's months are one bit each, in 32-bit words. Bitmaps are built by
``bit_or``, which partial aggregation reduces to a row per customer and word before the
shuffle, shifted so that the first month is bit 0, and counted per cohort and distinct
bitmap. What remains is a few rows per cohort and month, however many customers.

Active customers over a window of days are not counted by a distinct window
over all lines. Each customer's order days are merged into spans of activity; a span
adds one on its first day and takes one off when it ends, and a running sum over the
calendar is the number of active customers of every day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = 32
MASK = (1 << WORD) - 1


def month_bitmaps(orders: DataFrame, months: int) -> DataFrame:
    """``customer, first, bits``: the customer's first month (0 is the calendar's first) and the bits of
    the months from it on, an array of ``WORD``-bit words. ``orders`` has ``customer, month``."""
    words = months // WORD + 1
    m = F.col("month")
    bits = orders.groupBy("customer").agg(F.min("month").alias("first"), F.array(*[
        F.coalesce(F.bit_or(F.when(F.floor(m / WORD) == w, F.expr(f"shiftleft(1L, month % {WORD})"))), F.lit(0).cast("long"))
        for w in range(words)]).alias("raw"))
    # Shifted by whole words and then by bits, the upper bits from the next word.
    skip, by = F.floor(F.col("first") / WORD).cast("int"), (F.col("first") % WORD).cast("int")

    def word(w: int):
        def at(i):
            return F.coalesce(F.get("raw", skip + i), F.lit(0).cast("long"))
        low = F.call_function("shiftright", at(w), by)
        high = F.call_function("shiftleft", at(w + 1), F.lit(WORD) - by)
        return low.bitwiseOR(high).bitwiseAND(F.lit(MASK).cast("long"))
    return bits.select("customer", "first", F.array(*[word(w) for w in range(words)]).alias("bits"))


def cohorts(bitmaps: DataFrame, months: int) -> DataFrame:
    """``first, later, customers``: of the customers of each cohort those that order ``later`` months after their first."""
    kinds = bitmaps.groupBy("first", "bits").agg(F.count(F.lit(1)).alias("n"))
    later = kinds.select("first", "n", "bits", F.explode(F.sequence(F.lit(0), F.lit(months - 1) - F.col("first"))).alias("later"))
    bit = F.getbit(F.get("bits", F.floor(F.col("later") / WORD).cast("int")), F.col("later") % WORD)
    return (later.groupBy("first", "later").agg(F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("customers"))
            .filter("customers > 0"))


def active_months(bitmaps: DataFrame) -> DataFrame:
    """``active_months, customers``: how many months customers order in."""
    count = F.aggregate("bits", F.lit(0), lambda s, w: s + F.bit_count(w))
    return bitmaps.groupBy(count.alias("active_months")).agg(F.count(F.lit(1)).alias("customers"))


def rolling_active(orders: DataFrame, calendar: DataFrame, days: int) -> DataFrame:
    """``day, active``: for each day of ``calendar(day)`` the customers with an order in the ``days`` days up to it.

    ``orders`` has ``customer, day``, one row per customer and day at most.
    """
    own = Window.partitionBy("customer").orderBy("day")             # bounded by the calendar
    gaps = orders.select("day", F.datediff("day", F.lag("day").over(own)).alias("since"),
                         F.datediff(F.lead("day").over(own), "day").alias("until"))
    starts = gaps.filter(F.col("since").isNull() | (F.col("since") > days)).select("day", F.lit(1).alias("step"))
    ends = gaps.filter(F.col("until").isNull() | (F.col("until") > days)).select(
        F.date_add("day", days).alias("day"), F.lit(-1).alias("step"))
    steps = (starts.unionByName(ends).unionByName(calendar.select("day", F.lit(0).alias("step")))
             .groupBy("day").agg(F.sum("step").alias("step")))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)      # one row a calendar day
    return steps.select("day", F.sum("step").over(upto).alias("active")).join(calendar.select("day"), "day", "left_semi")
