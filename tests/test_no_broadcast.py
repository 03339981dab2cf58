"""With broadcasting disabled (the path for very large dimensions: salted
shuffle joins), the whole build and the queries on it give the same star
and answers."""

import uuid

import pytest

import __spark_entry__ as entry
from almacen.plans import catalog, warehouse
from almacen.session import shared_dir
from oracle_check import _rows, duck

SF = "/root/testdata/sf0.001"
NAMES = ["fact_ventas", "dim_cliente", "dim_producto", "q09_segment_share", "q10_top_customers",
         "q13_top_products", "q15_pareto", "q18_top3_country", "q20_rfm", "k2_market_gap", "audit_fk"]


@pytest.fixture(scope="module")
def big_dims_star(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # for build and queries
    try:
        s = warehouse.build(spark, SF, base=f"{shared_dir(spark)}/almacen-test/{uuid.uuid4().hex[:8]}")
        yield s
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_without_broadcast(spark, big_dims_star, name):
    saved = warehouse.pin(spark, SF, big_dims_star)
    try:
        df = catalog.registry()[name](spark, SF)
        s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    finally:
        warehouse.pin(spark, SF, saved)
    cur = duck(SF).execute(entry.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    assert _rows(s_cols, s_rows) == _rows(d_cols, cur.fetchall())


def test_layout_does_not_depend_on_the_join_path(spark, big_dims_star):
    """Files of a year hold disjoint ranges of dates and keys, and nothing of the work is left."""
    from pyspark.sql import functions as F

    from almacen.session import path_exists
    files = (big_dims_star.fact.groupBy("anio", F.input_file_name().alias("f"))
             .agg(F.min("ventas_id").alias("lo"), F.max("ventas_id").alias("hi")).orderBy("anio", "lo").collect())
    for a, b in zip(files, files[1:]):
        assert a["anio"] != b["anio"] or a["hi"] < b["lo"]
    assert not path_exists(spark, f"{big_dims_star.base}/_work")
