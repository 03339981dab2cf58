"""T1-T7: standardise the raw feed (rename, type, normalise).

Pure per-row projections: one narrow stage, no shuffle. Quantity and price are
coerced to numbers as the source does, without rounding: ``6.0`` is six, and
two prices that differ in the fifth decimal are two prices. Whether a number
fits the warehouse's types is decided when it is loaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import cancel_flag, norm_customer, norm_description

NUMBER = "double"


def _number(name: str) -> Column:
    """A finite number, or NULL."""
    n = F.col(name).try_cast(NUMBER)
    return F.when(F.abs(n) < F.lit(float("inf")), n)


#: A value of the usual layout, which a plain cast reads as the pattern does, at a tenth of the time.
USUAL = r"\A(?!0000)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"


def wall_clock(name: str, ts_format: str) -> Column:
    """The written date and time without a zone, or NULL: the same under every session clock."""
    c, fmt = F.col(name), F.lit(ts_format)
    read = F.when(F.try_to_timestamp(c, fmt).isNotNull(), F.to_timestamp_ntz(c, fmt))
    if ts_format != "yyyy-MM-dd HH:mm:ss":
        return read
    return F.when(c.rlike(USUAL), c.try_cast("timestamp_ntz")).otherwise(read)


def unparsed_dates(raw: DataFrame, ts_format: str) -> DataFrame:
    """``(dates, unparsed)``: written dates, and those that ``ts_format`` does not read."""
    c = F.col("InvoiceDate")
    return raw.agg(F.count(c).alias("dates"),
                   F.count_if(c.isNotNull() & wall_clock("InvoiceDate", ts_format).isNull()).alias("unparsed"))


def stage(raw: DataFrame, ts_format: str = fixed.INVOICE_TS_FORMAT) -> DataFrame:
    """Raw 8 string columns -> typed, normalised staged lines (9 columns)."""
    df = raw.toDF(*fixed.STAGED_COLUMNS)                                   # T1 by position
    return df.select(
        F.col("invoice"),
        F.col("stock_code"),
        norm_description(F.col("description")).alias("description"),      # T7
        _number("quantity").alias("quantity"),                            # T4
        wall_clock("invoice_date", ts_format).alias("invoice_date"),     # T2
        _number("price").alias("price"),                                  # T3
        norm_customer(F.col("customer_id")).alias("customer_id"),         # T5
        F.col("country"),
        cancel_flag(F.col("invoice")).alias("is_cancelled"),              # T6
    )
