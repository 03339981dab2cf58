"""T8-T13: de-duplicate, drop invalid lines, compute the line total.

The removal steps run in a fixed order and each row is charged to the first
rule it fails. Instead of five filters and five counts, every de-duplicated
row is tagged once with that rule (a ``when`` chain); the clean lines are the
untagged rows and the cleaning ledger is a single ``groupBy(rule)``.

Scale: the only shuffle is the exact-row de-duplication, a hash aggregate
with map-side partial aggregation, so a heavily repeated line collapses
before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

RULE_SPECIAL = "special_code"
RULE_PRICE = "price"
RULE_QUANTITY = "quantity"
RULE_DATE = "date"
RULES = [RULE_SPECIAL, RULE_PRICE, RULE_QUANTITY, RULE_DATE]
STEP_DEDUP = "duplicates"
STEP_QUARANTINE = "quarantine"

LINE_TOTAL_TYPE = "decimal(18,2)"
FACTOR_TYPE = "decimal(18,6)"


def dedup(staged: DataFrame) -> DataFrame:
    """T8: exact duplicate rows after normalisation (NULL equals NULL)."""
    return staged.dropDuplicates()


def removal_rule(df: DataFrame):
    """First failing rule of T9-T12, or NULL when the row is kept.

    NULL price/quantity do not fail T10/T11 (the source's comparisons with
    a missing value are false) and a NULL stock code is not special.
    """
    active = F.col("is_cancelled") == 0
    # ``when`` treats a NULL condition as not matched, i.e. the row is kept.
    return (
        F.when(F.col("stock_code").isin(fixed.SPECIAL_CODES), F.lit(RULE_SPECIAL))
        .when((F.col("price") <= 0) & active, F.lit(RULE_PRICE))
        .when((F.col("quantity") <= 0) & active, F.lit(RULE_QUANTITY))
        .when(F.col("invoice_date").isNull(), F.lit(RULE_DATE))
    )


def tag(staged: DataFrame) -> DataFrame:
    """De-duplicated staged lines with a ``rule`` column (NULL = kept)."""
    d = dedup(staged)
    return d.withColumn("rule", removal_rule(d))


def line_total(df: DataFrame) -> DataFrame:
    """T13: round(quantity * price, 2), negative for cancellations.

    The product of the two numbers as they were written is exact; a total
    that no DECIMAL holds is NULL and sends its line to quarantine.
    """
    exact = F.col("quantity").try_cast(FACTOR_TYPE) * F.col("price").try_cast(FACTOR_TYPE)
    return df.withColumn("total_line", F.round(exact, 2).try_cast(LINE_TOTAL_TYPE))


def clean_from_tagged(tagged: DataFrame) -> DataFrame:
    return line_total(tagged.filter(F.col("rule").isNull()).drop("rule"))


def clean(staged: DataFrame) -> DataFrame:
    """T8-T13 in one go (clean lines without the ledger)."""
    return clean_from_tagged(tag(staged))


def ledger(raw_rows: DataFrame, tagged: DataFrame, quarantine: DataFrame) -> DataFrame:
    """D9: rows removed per step, in step order, with the running row count.

    ``raw_rows`` is the staged (pre-dedup) frame; only its count is used. The
    last step counts the lines that no rule removes but that do not fit the
    warehouse's types, so what remains after it is the fact.
    """
    spark = tagged.sparkSession
    raw_n = raw_rows.agg(F.count(F.lit(1)).alias("n"))
    held = quarantine.agg(F.lit(STEP_QUARANTINE).alias("rule"), F.count(F.lit(1)).alias("n"))
    per_rule = tagged.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).unionByName(held)
    names = [STEP_DEDUP, *RULES, STEP_QUARANTINE]
    steps = spark.createDataFrame(list(enumerate(names)), "step_no int, step string")
    dedup_n = tagged.agg(F.count(F.lit(1)).alias("n"))
    removed_dup = raw_n.scalar() - dedup_n.scalar()
    removed = (steps.join(per_rule, steps.step == per_rule.rule, "left")
               .select("step_no", "step",
                       F.when(F.col("step") == STEP_DEDUP, removed_dup)
                        .otherwise(F.coalesce(F.col("n"), F.lit(0))).cast("bigint")
                        .alias("rows_removed")))
    w = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Six rows: a single-partition window is the right tool here.
    return removed.withColumn(
        "rows_after", (raw_n.scalar() - F.sum("rows_removed").over(w)).cast("bigint"))
