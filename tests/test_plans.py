"""Physical-plan properties that the design relies on at scale (read from
``explain``): top-k limits before the shuffle, filters and column pruning at
the Parquet scan, partition pruning on the fact's year layout, and
broadcasts only where a size check allows them."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from almacen.operators.scale import lookup_join
from almacen.plans import queries


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())       # drop expression ids


def test_top_k_per_country_is_limited_before_the_shuffle(star):
    p = plan(queries.q18_top3_country(star))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_global_top_k_never_sorts_everything_in_one_task(star):
    for q in (queries.q10_top_customers, queries.q13_top_products, queries.k3_top5_share):
        p = plan(q(star))
        assert "WindowGroupLimit" in p or "TakeOrderedAndProject" in p, q.__name__


def test_filters_and_columns_reach_the_scan(star):
    p = plan(queries.q14_return_rate(star))
    fact_scan = [l for l in p.splitlines() if "ReadSchema" in l and "total_linea" not in l
                 and "cantidad" in l]
    assert fact_scan and "invoice_number" not in fact_scan[0] and "ventas_id" not in fact_scan[0]
    p = plan(queries.q17_geo_share(star))
    assert "EqualTo(is_cancelled,0)" in p


def test_year_filter_prunes_fact_partitions(star):
    p = plan(star.fact.filter(F.col("anio") == 1998).agg(F.sum("total_linea")))
    assert "PartitionFilters: [isnotnull(anio" in p and "(anio = 1998)" in p


def test_dimension_broadcast_only_behind_size_check(spark, star):
    fact = star.fact.select("producto_id", "total_linea")
    dim = star["dim_producto"].select(F.col("producto_id").alias("k"), "stock_code")
    small = plan(lookup_join(fact, dim, "producto_id", "k", dim_bytes=1000))
    big = plan(lookup_join(fact, dim, "producto_id", "k", dim_bytes=10**11))
    assert "BroadcastHashJoin" in small
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = plan(lookup_join(fact, dim, "producto_id", "k", dim_bytes=10**11))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in big and "__salt" in big


def test_kpis_do_not_multiply_lines(star):
    assert "Expand" not in plan(queries.q01_kpis(star)) and "Expand" not in plan(queries.k4_business_hours(star))


def test_region_years_need_no_dates(star):
    assert "fecha" not in plan(queries.q19_region_yoy(star)).replace("fecha_id", "")


def test_dates_are_joined_to_daily_sums(star):
    for q in (queries.q03_running_month, queries.q05_month_rank, queries.q05_month_rank_by_year):
        text = plan(q(star))
        assert text.index("Join") < text.index("HashAggregate", text.index("Join")), q.__name__


def test_customers_are_reduced_by_hash(star):
    from almacen.operators.dims import _customer_stats
    lines = [x for x in plan(_customer_stats(star.clean)).splitlines() if "Aggregate" in x and "+-" in x]
    # Read from the scan upwards: the aggregates over the lines come last in the tree.
    assert lines and "HashAggregate" in lines[-1] and "HashAggregate" in lines[-2]


def test_queries_write_nothing_into_the_warehouse(spark, star):
    from almacen.session import file_stamps
    before = file_stamps(spark, star.base)
    for q in (queries.q13_top_products, queries.q15_pareto, queries.q20_rfm):
        q(star).collect()
    assert file_stamps(spark, star.base) == before
