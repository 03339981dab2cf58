"""Steps whose memory or volume must not grow faster than their input: what they read, repeat and send."""

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from almacen import session
from almacen.operators import fact, history, profile, reconcile, scale, stage
from almacen.sources import csv, feed, sinks


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_are_not_repeated_for_the_months_they_last(spark):
    """an interval of fifty years is one row of the join, and no side of it is sent whole."""
    day = lambda y, m=1, d=1: dt.date(y, m, d)
    spans = spark.createDataFrame(
        [(1, 1, 5, day(1950), day(2000)), (1, 2, 6, day(2000), None), (2, 1, 7, day(1999, 3, 2), None)],
        "cliente_id int, version int, geografia_id int, valid_from date, valid_to date")
    lines = spark.createDataFrame(
        [(1, 1, day(1949)), (1, 2, day(1950)), (1, 3, day(1999, 12, 31)), (1, 4, day(2000)), (1, 5, day(2001, 5, 31)),
         (1, 6, day(2001, 6, 1)), (2, 7, day(1999, 3, 1)), (2, 8, day(1999, 3, 2)), (3, 9, day(1999)), (None, 10, day(1999)), (1, 11, None)],
        "cliente_id int, n int, fecha_completa date")
    last = spark.createDataFrame([(day(2001, 5, 3),)], "d date")
    found = history.valid_at(lines, spans, "fecha_completa", last)
    assert {r["n"]: (r["version"], r["valid_geografia"]) for r in found.collect()} == {
        1: (None, None), 2: (1, 5), 3: (1, 5), 4: (2, 6), 5: (2, 6), 6: (None, None), 7: (None, None), 8: (1, 7),
        9: (None, None), 10: (None, None), 11: (None, None)}
    assert "Generate" not in _plan(found)


def test_difference_reads_a_table_once_and_again_only_for_what_it_has_more(spark):
    """all buckets differ here, and still the table with fewer rows is read once."""
    reads = {s: spark.sparkContext.accumulator(0) for s in "ab"}

    def counted(df, side):
        seen = reads[side]

        def touch(k):
            seen.add(1)
            return k
        return df.select(F.udf(touch, "long").asNondeterministic()("k").alias("k"), "text")
    b = spark.range(60_000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("text"))
    a = b.unionByName(b.filter("k % 2 = 0")).unionByName(b.filter("k % 10 = 0"))
    found, seen = reconcile.difference(counted(a, "a"), counted(b, "b"))
    assert seen["coarse"] == reconcile.COARSE and seen["fine"] > 10_000
    n = found.groupBy("side", "copies").count().collect()
    assert {(r["side"], r["copies"]): r["count"] for r in n} == {("a", 1): 24_000, ("a", 2): 6_000}
    assert found.filter("text is null").count() == b.filter("k % 2 = 0 and text is null").count()
    assert reads["b"].value == 60_000 and reads["a"].value == 2 * 96_000


def test_duplicates_are_counted_by_digest_and_compared_whole_only_where_it_occurs_again(spark):
    """no task holds the rows that occur once."""
    rows = [("i", "6.95"), ("i", "6.950"), ("i", "7"), (None, "7"), (None, "7"), (None, "7"), ("j", None), ("j", None), ("k", "1")]
    schema = "Invoice string, Price string"
    raw = spark.createDataFrame(rows, schema)
    counted = profile.duplicate_count(raw)
    assert counted.first()[0] == 4
    assert profile.duplicate_count(raw.unionByName(spark.createDataFrame([("i", "n/a")], schema))).first()[0] == 3
    assert profile.duplicate_count(raw.limit(0)).first()[0] == 0
    whole = _plan(counted).split("LeftSemi")
    assert len(whole) == 2 and "RepartitionByExpression [h1" in whole[1]


def test_usual_dates_are_read_without_the_pattern(spark):
    """same readings as the pattern's, which then sees only the other values; and a look-up is measured by its keys."""
    written = ["2021-02-03 04:05:06", "2021-02-30 04:05:06", "2021-02-03 24:00:00", "2021-02-03 23:59:60", "0000-01-01 00:00:00",
               "0001-01-01 00:00:00", "2021-02-03T04:05:06", " 2021-2-03 04:05:06", "2021-02-03 04:05:06\n", "not-a-date", "", None]
    df = spark.createDataFrame([(x,) for x in written], "InvoiceDate string")
    fmt = F.lit("yyyy-MM-dd HH:mm:ss")
    c = F.col("InvoiceDate")
    slow = F.when(F.try_to_timestamp(c, fmt).isNotNull(), F.to_timestamp_ntz(c, fmt))
    fast = stage.wall_clock("InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    assert df.filter(~slow.eqNullSafe(fast)).count() == 0 and df.filter(fast.isNotNull()).count() == 3
    read = df.select(fast.alias("t"))._jdf.queryExecution().analyzed().toString()
    assert "try_cast(InvoiceDate" in read and read.index("try_cast") < read.index("timestamp(InvoiceDate")


def test_look_ups_carry_only_what_they_need(spark, star):
    """totals and dates are computed after the joins, which may shuffle the lines, and descriptions end with the order."""
    sizes = fact.lookup_bytes(star.tables)
    assert sizes["dim_producto"] < scale.measured_bytes(star["dim_producto"])
    keyed = fact.resolve_keys(star.clean, star.tables, dict.fromkeys(sizes, 10 ** 12) | {"dim_fecha": 1})
    assert keyed.columns == [*star.clean.columns, "fecha_completa", "fecha_id", "cliente_id", "producto_id", "geografia_id"]
    salted = [x for x in _plan(keyed).splitlines() if "xxhash64(" in x]
    assert len(salted) == 3 and not any("total_line" in x.split("xxhash64(")[1].split(")")[0] for x in salted)
    numbered = scale.with_row_number(keyed, fact.FACT_ORDER, "ventas_id", leave=["description"])
    assert "description" not in numbered.columns and numbered.count() == star.clean.count()


def _shuffle_files(spark):
    """Names of the shuffle files that this (local) session holds on disk."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n.rsplit("/", 1)[1] for n in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in n}


def _wait_for(holds, seconds=10):
    """Shuffle files are deleted in the background."""
    until = time.time() + seconds
    while not holds() and time.time() < until:
        time.sleep(0.1)
    return holds()


def test_a_written_table_leaves_no_shuffle_files(spark, scratch):
    """F3-F12: what made a table goes when it is written; the session's own setting comes back, also after threads."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, before = spark.conf.get(key, None), _shuffle_files(spark)

    def write(i):
        df = spark.range(2000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s"))
        return session.write_table(df, scratch(f"shuffled-{i}"), codec=session.DENSE)
    with ThreadPoolExecutor(4) as pool:
        written = list(pool.map(write, range(8)))
    assert _wait_for(lambda: not _shuffle_files(spark) - before)
    assert spark.conf.get(key, None) == own
    assert [t.count() for t in written] == [50] * 8
    # A result that nothing replaces is left alone: it can be collected again.
    df = spark.range(100).repartition(3)
    assert len(df.collect()) == len(df.collect()) == 100


def test_the_landed_feed_is_compressed_and_reads_back_as_it_was(spark, star, scratch):
    """F3-F12: the landing CSV was the largest table of a build."""
    path, plain = scratch("landed"), scratch("plain")
    csv.write_csv(star.landing, path)
    star.landing.write.options(**csv.DIALECT).csv(plain)
    size = [sum(x[1] for x in session.file_stamps(spark, p)) for p in (path, plain)]
    assert 2 * size[0] < size[1]
    again = csv.csv_scan(spark, path)
    assert again.exceptAll(star.landing).isEmpty() and star.landing.exceptAll(again).isEmpty()


def test_lines_are_not_moved_to_meet_customers(spark):
    """F3-F12: the customers join the orders; no join with them has the lines on either side."""
    plan = feed.derived_feed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joins = [plan.apply(i) for i in range(60) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Join"]
    met = [j for j in joins if "c_custkey" in j.condition().toString()]
    assert len(joins) == 4 and len(met) == 1
    assert "l_orderkey" not in met[0].output().mkString(",")


def test_the_fact_is_written_from_its_numbered_ranges(spark, scratch):
    """F3-F12: numbering has dealt the lines by date, so the layout moves none of them again."""
    before = _shuffle_files(spark)
    lines = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("x")).select(
        (F.col("k") + 1).alias("order"), F.lit("i").alias("invoice_number"), F.floor(F.col("k") / 100).cast("int").alias("fecha_id"),
        *[F.lit(1).alias(c) for c in ("hora_venta", "cliente_id", "producto_id", "geografia_id", "cantidad", "precio_unitario",
                                      "total_linea", "is_cancelled")], (F.lit(2000) + F.floor(F.col("k") / 1500)).cast("int").alias("anio"))
    numbered = scale.with_row_number(lines, ["order"], "ventas_id", num_partitions=9)
    assert _wait_for(lambda: not _shuffle_files(spark) - before)
    plans = []
    real = sinks.write_table
    sinks.write_table = lambda df, *a, **b: plans.append(df) or real(df, *a, **b)
    try:
        fact = sinks.write_fact(sinks.conform(numbered, "fact_ventas", keep=("anio",)), scratch("ranged-fact"), True)
    finally:
        sinks.write_table = real
    assert "repartition" not in _plan(plans[0]).lower()
    files = (fact.groupBy("anio", F.input_file_name().alias("f")).agg(F.min("ventas_id").alias("lo"), F.max("ventas_id").alias("hi"))
             .orderBy("lo").collect())
    assert len(files) > 9 and files[0]["lo"] == 1 and files[-1]["hi"] == 5000
    assert all(a["hi"] + 1 == b["lo"] for a, b in zip(files, files[1:]))
    assert {(r["ventas_id"] - 1) // 100 == r["fecha_id"] for r in fact.collect()} == {True}


def test_keys_are_looked_up_without_moving_the_lines_up_to_a_budget(spark):
    """F3-F12: under a low threshold both large look-ups shuffled every line whole."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(key, None)
    facts, dim = spark.range(100).select(F.col("id").alias("k")), spark.range(100).select(F.col("id").alias("dk"), F.lit(1).alias("v"))
    try:
        spark.conf.set(key, "100k")
        assert "broadcast" in _plan(scale.lookup_join(facts, dim, "k", "dk", scale.LOOKUP_BYTES)).lower()
        assert "__salt" in _plan(scale.lookup_join(facts, dim, "k", "dk", scale.LOOKUP_BYTES + 1))
        spark.conf.set(key, "-1")
        assert scale.lookup_budget(spark) == -1
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
