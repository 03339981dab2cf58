"""S4: clustered access paths find the same lines and open few files."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from almacen.plans import warehouse
from almacen.sources import access

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return warehouse.star(spark, SF)


def test_ranks_and_interleaving(spark):
    rnd = random.Random(1)
    cuts = sorted(rnd.choices(range(50), k=15))
    df = spark.createDataFrame([(v,) for v in [*range(-2, 55)]] + [(None,)], "v int")
    got = {r[0]: r[1] for r in df.select("v", access.rank_of(F.col("v"), cuts)).collect()}
    assert got == {v: bisect.bisect_left(cuts, v) for v in range(-2, 55)} | {None: 0}
    assert df.select(access.rank_of(F.col("v"), []).alias("r")).distinct().collect() == [(0,)]

    rows = [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(50)]
    z = [r[0] for r in spark.createDataFrame(rows, "a int, b int, c int").coalesce(1).select(
        access.interleave([F.col(c) for c in "abc"])).collect()]
    assert z == [int("".join(f"{x:08b}"[i] for i in range(8) for x in r), 2) for r in rows]


@pytest.mark.parametrize("key", ["cliente_id", "producto_id", "geografia_id"])
def test_a_look_up_opens_under_a_fifth_of_the_files(big, key):
    fact, made = big.fact, big.access["fact_ventas"]
    shares = fact.groupBy(key).count().orderBy("count", key).collect()
    # From rare to common, but for the few members that hold a large share of all lines.
    for row in [shares[0], shares[len(shares) // 2], shares[len(shares) * 3 // 4]]:
        seen = made.report(**{key: row[key]})
        assert seen["files"] == 512 and 5 * seen["files_read"] < seen["files"]
        assert seen["lines"] == big.rows["fact_ventas"] and seen["lines_read"] * 5 < seen["lines"]
        found = made.lookup(**{key: row[key]})
        want = fact.filter(F.col(key) == row[key])
        assert found.count() == row["count"]
        assert found.select("ventas_id").exceptAll(want.select("ventas_id")).isEmpty()


def test_hot_and_missing_keys(big):
    made = big.access["fact_ventas"]
    hot = big.unknown_key
    assert made.lookup(cliente_id=hot).count() == big.fact.filter(F.col("cliente_id") == hot).count()
    both = made.report(cliente_id=hot, producto_id=3)
    assert both["files_read"] <= made.report(producto_id=3)["files_read"]
    assert made.lookup(cliente_id=hot, producto_id=3).count() == big.fact.filter(f"cliente_id = {hot} and producto_id = 3").count()
    assert made.lookup(cliente_id=-5).count() == 0 and made.report(cliente_id=-5)["files_read"] == 0


def test_paths_of_dates_flag_and_dimensions(big):
    a = big.access
    day = a["fact_by_date"].report(fecha_id=100)
    assert day["files_read"] <= 2 and a["fact_by_date"].lookup(fecha_id=100).count() == big.fact.filter("fecha_id = 100").count()
    cancelled = big.fact.filter("is_cancelled = 1").count()
    seen = a["fact_ventas"].report(is_cancelled=1)
    assert cancelled <= seen["lines_read"] <= cancelled + 2 * seen["lines"] / seen["files"]
    vip = a["dim_cliente"].lookup(segmento="VIP")
    assert vip.count() == big["dim_cliente"].filter("segmento = 'VIP'").count() and vip.columns == big["dim_cliente"].columns
    assert a["dim_fecha"].lookup(anio=1995, mes=3).count() == 31


def test_keys_have_bloom_filters(spark, scratch):
    import duckdb
    df = spark.range(4000).select(F.col("id").alias("ventas_id"), (F.col("id") * 7919 % 4000).cast("int").alias("cliente_id"),
                                  F.lit(0).alias("is_cancelled"), F.lit(1).alias("producto_id"), F.lit(1).alias("geografia_id"))
    old = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.enable.dictionary")
    # Without dictionaries, which Parquet prefers where the keys fit one.
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.enable.dictionary", "false")
    try:
        made = access.cluster(df, access.PATHS["fact_ventas"], 4000, scratch("bloom"))
    finally:
        if old is None:
            spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.enable.dictionary")
        else:
            spark.sparkContext._jsc.hadoopConfiguration().set("parquet.enable.dictionary", old)
    file = made.index.first()["file"].removeprefix("file://")
    found = duckdb.sql(f"SELECT DISTINCT path_in_schema FROM parquet_metadata('{file}') WHERE bloom_filter_offset IS NOT NULL")
    assert {c for (c,) in found.fetchall()} == {"cliente_id", "producto_id", "geografia_id"}
    assert made.lookup(cliente_id=77).count() == 1 and made.report(cliente_id=77)["files_read"] < 10


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "ventas_id long, cliente_id int, producto_id int, geografia_id int, is_cancelled int")
    made = access.cluster(df, access.PATHS["fact_ventas"], 0, scratch("none"))
    assert made.report(cliente_id=1) == {"files": 0, "lines": 0, "files_read": 0, "lines_read": 0}
    assert made.lookup(cliente_id=1).count() == 0
