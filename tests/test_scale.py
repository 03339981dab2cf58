"""The parallel order helpers agree with Spark's single-partition windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from almacen.operators.scale import lookup_join, measured_bytes, ntile_cuts, with_row_number, with_running_sum

SF = "/root/testdata/sf0.01"


def _customers(spark):
    # 1,500 customers with many tied balances (rounded down to hundreds).
    return (spark.read.parquet(f"{SF}/customer.parquet")
            .select("c_custkey", (F.floor(F.col("c_acctbal") / 100) * 100).cast("long").alias("bal")))


def test_row_number_matches_global_window(spark):
    df = _customers(spark)
    got = with_row_number(df, [F.col("bal").desc(), "c_custkey"], "rn", num_partitions=6)
    ref = df.withColumn("rn_ref", F.row_number().over(Window.orderBy(F.col("bal").desc(), "c_custkey")))
    j = got.join(ref, "c_custkey")
    assert j.count() == df.count()
    assert j.filter(F.col("rn") != F.col("rn_ref")).count() == 0
    assert got.agg(F.min("rn"), F.max("rn")).first() == (1, df.count())


def test_running_sum_matches(spark):
    df = _customers(spark)
    order = [F.col("bal"), F.col("c_custkey")]
    got = with_running_sum(df, order, "bal", "cum", rn_name="rn", num_partitions=5)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum_ref", F.sum("bal").over(w)).withColumn(
        "rn_ref", F.row_number().over(Window.orderBy(*order)))
    j = got.join(ref, "c_custkey")
    assert j.filter((F.col("cum") != F.col("cum_ref")) | (F.col("rn") != F.col("rn_ref"))).count() == 0


def test_ntile_cuts_match(spark):
    df = _customers(spark)
    order = [F.col("bal").desc(), F.col("c_custkey")]
    cuts = [tuple(r) for r in ntile_cuts(df, order, 5)]
    ref = df.withColumn("tile", F.ntile(5).over(Window.orderBy(*order))).withColumn(
        "rn", F.row_number().over(Window.partitionBy("tile").orderBy(*order)))
    want = [tuple(r)[:2] for r in ref.filter("rn = 1 and tile > 1").orderBy("tile").collect()]
    assert cuts == want


def test_running_sum_total(spark):
    df = _customers(spark)
    got = with_running_sum(df, [F.col("c_custkey")], "bal", "cum", total_name="total", num_partitions=4)
    assert [r[0] for r in got.select("total").distinct().collect()] == [df.agg(F.sum("bal")).first()[0]]


def test_one_value_in_half_the_rows_is_split(spark, scratch):
    """The key breaks ties, so a measure that half of the rows share fills no partition alone."""
    from almacen.operators.scale import _ranged
    df = spark.range(0, 40000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("v"))
    sizes = [r["count"] for r in _ranged(df, ["v", "id"], 8, "half").groupBy("__pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_measured_bytes_follow_the_text(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "é" * 100)], "k int, t string")
    assert measured_bytes(df) == 3 * 48 + 3 + 200 and measured_bytes(df.limit(0)) == 0


def test_lookup_join_skew_path_equals_broadcast(spark):
    # A fact side where one key holds a third of the rows; force the shuffle path.
    facts = (spark.range(0, 30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k")))
    dim = spark.range(0, 500).select(F.col("id").alias("dk"), (F.col("id") * 10).alias("v"))
    fast = lookup_join(facts, dim, "k", "dk", dim_bytes=8000)
    slow = lookup_join(facts, dim, "k", "dk", dim_bytes=10 ** 12)
    a = fast.select("id", "k", "v")
    b = slow.select("id", "k", "v")
    assert a.count() == b.count() == 30000
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_key_detected_on_sample(spark):
    from almacen.operators.scale import hot_keys
    facts = (spark.range(0, 300000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k")))
    got = hot_keys(facts, "k", 8).collect()
    assert [r["__hk"] for r in got] == [7] and got[0]["__salts"] == 3   # a third of 8 tasks
