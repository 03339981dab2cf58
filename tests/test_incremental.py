"""S2 refresh: a build and a refresh equal a full build but for the keys; only changed years are rewritten."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from almacen import session
from almacen.plans import queries, refresh, warehouse


def _natural(s):
    """The star without surrogate keys."""
    t = s.tables
    fact = (s.fact.join(t["dim_fecha"].select("fecha_id", "fecha_completa"), "fecha_id")
            .join(t["dim_cliente"].select("cliente_id", "customer_id"), "cliente_id")
            .join(t["dim_producto"].select("producto_id", "stock_code"), "producto_id")
            .join(t["dim_geografia"].select("geografia_id", "country"), "geografia_id")
            .drop("ventas_id", "fecha_id", "cliente_id", "producto_id", "geografia_id"))
    out = {"fact": Counter(tuple(r[c] for c in sorted(fact.columns)) for r in fact.collect())}
    for name, (_, key) in refresh.KEYS.items():
        out[name] = Counter(tuple(r) for r in t[name].drop(key).collect())
    days = t["dim_fecha"].orderBy("fecha_completa").collect()
    out["dates"] = [r["fecha_completa"] for r in days]
    assert [r["fecha_id"] for r in days] == sorted({r["fecha_id"] for r in days})        # keys follow the calendar
    assert s.fact.count() == s.fact.select("ventas_id").distinct().count() == s.rows["fact_ventas"]
    return out


def _keys(s, dim):
    natural, key = refresh.KEYS[dim]
    return {r[0]: r[1] for r in s[dim].select(natural, key).collect()}


def _year(c="InvoiceDate"):
    return F.substring(c, 1, 4)


@pytest.fixture(scope="module")
def feed(star):
    return star.landing


def test_new_corrected_and_vanished_lines(spark, star, feed, scratch):
    base = scratch("incremental")
    # Then: no 1998 yet, other prices in 1995, and a customer that has gone by now.
    extra = feed.filter(_year() == "1996").limit(3).withColumn("Customer ID", F.lit("99999.0"))
    old_feed = (feed.filter(_year() != "1998").withColumn("Price", F.when(_year() == "1995", F.lit("5.55")).otherwise(F.col("Price")))
                .unionByName(extra))
    first = warehouse.build(spark, None, base=base, raw=old_feed)
    stamps = session.file_stamps(spark, f"{first.base}/fact_ventas")
    ids = {d: _keys(first, d) for d in refresh.KEYS}
    lines = {r["ventas_id"]: tuple(r) for r in first.fact.select("ventas_id", *refresh.SAME).collect()}

    now = refresh.refresh(spark, base, raw=feed)
    full = _natural(star)
    got = _natural(now)
    assert got == full
    # Rewritten are the years that differ, and those after a date that came late (1998 precedes later years here).
    assert refresh.rewritten(now) == [1995, 1996, 1998, 1999, 2000, 2001]
    assert session.file_stamps(spark, f"{first.base}/fact_ventas") == stamps
    written = {p.split("anio=")[1][:4] for p, _, _ in session.file_stamps(spark, f"{now.base}/fact_ventas") if "anio=" in p}
    assert written == {str(y) for y in refresh.rewritten(now)}
    # Keys of members stay, and so do those of lines whose values (date keys apart) did not change.
    for d in refresh.KEYS:
        later = _keys(now, d)
        assert all(later[k] == v for k, v in ids[d].items() if k in later)
    assert "99999" in ids["dim_cliente"] and "99999" not in _keys(now, "dim_cliente")
    same = {r["ventas_id"]: tuple(r) for r in now.fact.filter("anio < 1998 and anio <> 1995").select("ventas_id", *refresh.SAME).collect()}
    assert all(lines[i] == row for i, row in same.items())

    # The questions, with ties only by value, answer alike.
    for name in ("q01_kpis", "q03_running_month", "q06_ticket_quarter", "q09_segment_share", "q11_new_customers",
                 "q14_return_rate", "q16_price_vs_ref", "q17_geo_share", "q19_region_yoy"):
        assert Counter(map(tuple, queries.ANALYTIC[name](now).collect())) == Counter(map(tuple, queries.ANALYTIC[name](star).collect()))

    # Back again: the customer comes back under the old key, and nothing is numbered twice.
    back = refresh.refresh(spark, base, raw=old_feed)
    assert _natural(back) == _natural(first) | {"dates": _natural(back)["dates"]}
    assert _natural(back)["dates"] == _natural(first)["dates"]
    assert _keys(back, "dim_cliente")["99999"] == ids["dim_cliente"]["99999"]
    top = max(r[0] for r in now.fact.select("ventas_id").collect())
    fresh = {r[0] for r in back.fact.select("ventas_id").collect()} - set(lines)
    assert all(i > top for i in fresh)

    # Builds that hold years of kept ones stay.
    assert os.path.basename(first.base) not in warehouse.retire(spark, base, keep=1)
    assert _natural(warehouse.load(spark, base))["fact"] == _natural(back)["fact"]


def test_a_year_more_rewrites_that_year_alone(spark, star, feed, scratch):
    base = scratch("append")
    first = warehouse.build(spark, None, base=base, raw=feed.filter(_year() != "2001"))
    now = refresh.refresh(spark, base, raw=feed)
    assert refresh.rewritten(now) == [2001] and _natural(now) == _natural(star)
    old = {tuple(r) for r in first.fact.collect()}
    assert old == {tuple(r) for r in now.fact.filter("anio < 2001").collect()}


def test_an_unchanged_feed_changes_nothing(spark, feed, scratch):
    base = scratch("unchanged")
    some = feed.filter(_year().isin("1996", "1997"))
    first = refresh.refresh(spark, base, raw=some)                    # no star yet: a full build
    again = refresh.refresh(spark, base, raw=some.repartition(3))
    assert again.base == first.base and warehouse.published(spark, base) == [os.path.basename(first.base)]


def test_lines_without_dates_and_held_back(spark, feed, scratch):
    base = scratch("held")
    some = feed.filter(_year() == "1997")
    first = warehouse.build(spark, None, base=base, raw=some)
    wide = some.limit(2).withColumn("Quantity", F.lit("2.5"))                # does not fit INT: quarantine
    undated = some.limit(4).withColumn("InvoiceDate", F.lit("soon"))
    feed2 = some.unionByName(wide).unionByName(undated)
    now = refresh.refresh(spark, base, raw=feed2, max_unparsed_dates=1.0)
    full = warehouse.build(spark, None, base=scratch("held-full"), raw=feed2, max_unparsed_dates=1.0)
    assert now.rows["quarantine"] == full.rows["quarantine"] > first.rows["quarantine"]
    assert _natural(now) == _natural(full)
    assert now.tagged.groupBy("rule").count().exceptAll(full.tagged.groupBy("rule").count()).isEmpty()


def test_summary_tells_null_places_apart(spark):
    cols = "invoice string, stock_code string, invoice_date timestamp_ntz"
    a = spark.createDataFrame([("x", None, None)], cols)
    b = spark.createDataFrame([(None, "x", None)], cols)
    assert refresh.changed_years(refresh.summary(a), refresh.summary(a)) == []
    assert refresh.changed_years(refresh.summary(a), refresh.summary(b)) == [warehouse.NO_YEAR]
    twice = a.unionByName(a).unionByName(a)
    assert refresh.changed_years(refresh.summary(a), refresh.summary(twice)) == [warehouse.NO_YEAR]
