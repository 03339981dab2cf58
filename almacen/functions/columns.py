"""Column expressions shared by the operators.

All helpers return native ``Column`` expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# The characters Python's str.strip() removes (those with str.isspace()):
# derived by rule, 29 code points including NBSP and U+001C..U+001F.
WHITESPACE = "".join(chr(cp) for cp in range(0x110000) if chr(cp).isspace())


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (not just spaces).

    ``trim`` with an explicit character set is code-generated and needs no
    regular expression.
    """
    return F.trim(c, F.lit(WHITESPACE))


def null_tokens(c: Column) -> Column:
    """Map CSV missing-value tokens to NULL."""
    return F.when(c.isin(fixed.CSV_NULL_TOKENS), F.lit(None)).otherwise(c)


def norm_customer(c: Column) -> Column:
    """NULL -> UNKNOWN, drop a trailing '.0', then strip (in that order)."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit(fixed.UNKNOWN_CUSTOMER)), r"\.0$", ""))


def norm_description(c: Column) -> Column:
    """NULL -> SIN DESCRIPCION, strip, upper-case."""
    return F.upper(strip_ws(F.coalesce(c, F.lit(fixed.NO_DESCRIPTION))))


def cancel_flag(invoice: Column) -> Column:
    """1 when the invoice number starts with an upper-case 'C', else 0."""
    return F.coalesce(invoice.startswith("C"), F.lit(False)).cast("int")


def segment(n: Column) -> Column:
    """Customer segment from the number of distinct non-cancelled invoices."""
    return (
        F.when(n == 0, F.lit(fixed.SEGMENT_UNKNOWN))
        .when(n == 1, F.lit(fixed.SEGMENT_NEW))
        .when(n <= fixed.SEGMENT_REGULAR_MAX, F.lit(fixed.SEGMENT_REGULAR))
        .when(n <= fixed.SEGMENT_FREQUENT_MAX, F.lit(fixed.SEGMENT_FREQUENT))
        .otherwise(F.lit(fixed.SEGMENT_VIP))
    )


def segment_documented(customer_id: Column, n: Column) -> Column:
    """Segment as the documentation describes it: no customer id -> UNKNOWN."""
    return (
        F.when(customer_id == fixed.UNKNOWN_CUSTOMER, F.lit(fixed.SEGMENT_UNKNOWN))
        .when(n <= 1, F.lit(fixed.SEGMENT_NEW))
        .when(n <= fixed.SEGMENT_REGULAR_MAX, F.lit(fixed.SEGMENT_REGULAR))
        .when(n <= fixed.SEGMENT_FREQUENT_MAX, F.lit(fixed.SEGMENT_FREQUENT))
        .otherwise(F.lit(fixed.SEGMENT_VIP))
    )


# --- numbers -----------------------------------------------------------------
#
# Money is summed and shown as exact DECIMAL. Ratios are computed in DOUBLE and
# rounded half away from zero, as SQL databases round: the magnitude goes
# through floor(x*100 + 0.5)/100, which is plain IEEE arithmetic and gives the
# same digits in any engine (``round(double)`` differs on binary ties), and the
# sign is put back.


def as_double(c: Column) -> Column:
    return c.cast("double")


def round2(c: Column) -> Column:
    """Round a DOUBLE half away from zero to 2 decimals, engine-independently."""
    up = F.floor(F.abs(c) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    return F.when(c < 0, -up).otherwise(up)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct(num: Column, den: Column) -> Column:
    """100 * num / den, rounded to 2 decimals; NULL when den is 0."""
    return round2(F.lit(100.0) * as_double(num) / F.nullif(as_double(den), F.lit(0.0)))


def money(c: Column) -> Column:
    """Exact amount in the warehouse's widest money type."""
    return c.cast("decimal(38,2)")

