"""Q01-Q20 and K1-K4: the business questions, as DataFrame plans on the star.

Conventions (shared with the DuckDB oracle):
* revenue = exact DECIMAL sum of ``total_linea`` over non-cancelled lines;
  orders = distinct non-cancelled invoices;
* ratios and percentages: DOUBLE arithmetic, rounded by ``round2``;
* "known" customers exclude the anonymous UNKNOWN member (compared by its
  surrogate key, read once per build, so the fact is never joined to the
  customer dimension just to filter);
* ties are broken by the natural key (customer id, stock code), which is
  the surrogate-key order, so plans sort on the integer key.

Plan shape: aggregate the fact by surrogate key first (partial aggregation
before the shuffle), then join the much smaller aggregate to a dimension.
Windows without ``partitionBy`` appear only over bounded row sets (years,
months, hours, segments, regions, countries, or a top-k after a
``WindowGroupLimit``); orderings over customers or products use the
parallel helpers in :mod:`operators.scale`, whose written tables lie below the
shared scratch folder (``session.release_scratch`` removes them), never in the
warehouse, which queries only read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import money, pct, ratio, round2
from ..operators import history, reconcile, retention, returns, sessions, sketches
from ..operators.scale import ntile_cuts, with_running_sum
from ..operators.segments import asof_join
from ..session import scratch_path, write_table
from .warehouse import Star

def _nonc() -> Column:
    return F.col("is_cancelled") == 0


def _rev() -> Column:
    """Line revenue counted in net sales (non-cancelled lines only)."""
    return F.when(_nonc(), F.col("total_linea"))


def _invoice_nonc() -> Column:
    return F.when(_nonc(), F.col("invoice_number"))


def known(star: Star) -> Column:
    """Lines of identified customers: every key but the anonymous member's.

    The anonymous key is one scalar per build, so the predicate is a literal
    comparison that Parquet can evaluate at the scan.
    """
    return ~F.col("cliente_id").eqNullSafe(F.lit(star.unknown_key).cast("int"))


def _dim(star: Star, name: str, *cols: str) -> DataFrame:
    return star[name].select(*cols)


def _with_dates(star: Star, df: DataFrame, *cols: str) -> DataFrame:
    """Attach date attributes to rows already aggregated by date (one row per day: bounded)."""
    df = df.drop(*[c for c in cols if c in df.columns])
    return df.join(_dim(star, "dim_fecha", "fecha_id", *cols), "fecha_id")


def _join_dim(star: Star, df: DataFrame, name: str, key: str, *cols: str) -> DataFrame:
    """Attach attributes to rows already aggregated by ``key``: unique on both
    sides, so no key is hot, and the planner broadcasts by the files' sizes."""
    return df.join(_dim(star, name, key, *cols), key)


# --- Group 1: global KPIs ----------------------------------------------------

def _distinct(df: DataFrame, column: str) -> Column:
    """Number of distinct non-NULL values, as a scalar over the pruned column (written as
    a grouping, since the optimizer merges several ``count_distinct`` scalars into one)."""
    return (df.select(column).filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one"))
            .agg(F.count("one")).scalar())


def q01_kpis(star: Star) -> DataFrame:
    """Business state: revenue, orders, ticket, cancellation rate, reach.

    Each distinct count is its own pruned scan: together in one aggregate
    they would multiply every line.
    """
    a = star.fact.agg(
        F.sum(_rev()).alias("rev"),
        F.sum("is_cancelled").alias("cancelled"),
        F.count(F.lit(1)).alias("lines"))
    a = a.select("*", _distinct(star.fact.filter(_nonc()), "invoice_number").alias("orders"),
                 _distinct(star.fact.filter(known(star)), "cliente_id").alias("customers"),
                 _distinct(star.fact, "producto_id").alias("products"),
                 _distinct(star.fact, "geografia_id").alias("countries"))
    return a.select(
        money(F.col("rev")).alias("revenue"),
        F.col("orders").cast("bigint").alias("orders"),
        round2(ratio(F.col("rev"), F.col("orders"))).alias("avg_ticket"),
        pct(F.col("cancelled"), F.col("lines")).alias("cancel_rate_pct"),
        F.col("customers").cast("bigint").alias("customers"),
        F.col("products").cast("bigint").alias("products"),
        F.col("countries").cast("bigint").alias("countries"))


def daily_sketches(star: Star) -> DataFrame:
    """The stored daily sketches of this star, made once per opened star."""
    return star.once("sketches", lambda: write_table(sketches.daily(star.fact, known(star)),
                                                     scratch_path(star.fact.sparkSession, "daily-sketches")))


def q01_sketch_ranges(star: Star) -> DataFrame:
    """Distinct customers and orders and the median price of any range of dates (here: each year) from
    merged daily sketches, and whether they lie within 5 % of the exact answer (of the rank, for the median)."""
    days = _with_dates(star, daily_sketches(star), "anio")
    about = sketches.merged(days, "anio").select("anio", "lines", F.col("customers").alias("c"), F.col("orders").alias("o"),
                                                 F.col("median_price").alias("m"))
    sold = star.fact.filter(_nonc())
    customers = sold.filter(known(star)).groupBy("anio").agg(F.count_distinct("cliente_id").alias("customers"))
    orders = sold.groupBy("anio").agg(F.count_distinct("invoice_number").alias("orders"))
    price = F.col("precio_unitario").cast("double")
    # A row a year on the right.
    ranks = sold.join(F.broadcast(about.select("anio", "m")), "anio").groupBy("anio").agg(
        ((F.count_if(price < F.col("m")) <= 0.55 * F.count(F.lit(1)))
         & (F.count_if(price <= F.col("m")) >= 0.45 * F.count(F.lit(1)))).alias("median_ok"))
    every = about.join(customers, "anio", "left").join(orders, "anio", "left").join(ranks, "anio", "left")

    def near(estimate: str, exact: Column) -> Column:
        return F.abs(F.coalesce(estimate, F.lit(0)) - exact) <= 0.05 * exact
    n, k = F.coalesce("customers", F.lit(0)), F.coalesce("orders", F.lit(0))
    return every.select(F.col("anio").cast("int").alias("anio"), F.col("lines").cast("bigint").alias("lines"),
                        n.cast("bigint").alias("customers"), near("c", n).alias("customers_ok"),
                        k.cast("bigint").alias("orders"), near("o", k).alias("orders_ok"),
                        F.coalesce("median_ok", F.lit(True)).alias("median_ok"))


def removed_duplicates(star: Star) -> DataFrame:
    """The lines that de-duplication removed, and how often: the multiset difference of the staged lines
    and those that were kept, found by comparing buckets of digests."""
    staged, kept = star.staged, star.tagged.drop("rule")
    found, _ = reconcile.difference(staged, kept)
    return found.withColumn("invoice_date", F.col("invoice_date").cast("string"))


def q08_sessions(star: Star) -> DataFrame:
    """Purchase sessions of known customers (no gap of over 30 days): how many have so many orders, and their days."""
    orders = star.fact.filter(_nonc() & known(star)).groupBy(F.col("cliente_id").alias("customer"), F.col("invoice_number")
                                                             .alias("invoice"), "fecha_id").agg(F.min("hora_venta").alias("hora"))
    orders = _with_dates(star, orders, "fecha_completa").groupBy("customer", "invoice").agg(
        F.min(F.datediff("fecha_completa", F.lit(datetime.date(1970, 1, 1))) * 24 + F.col("hora")).cast("long").alias("at"))
    s = sessions.sessions(orders, 24 * fixed.SESSION_GAP_DAYS)
    hours = F.col("last_at") - F.col("first_at")
    return s.groupBy("orders").agg(F.count(F.lit(1)).alias("n"), F.sum(hours).alias("hours")).select(
        F.col("orders").cast("bigint").alias("orders"), F.col("n").cast("bigint").alias("sessions"),
        round2(ratio(F.col("hours"), F.col("n") * 24)).alias("avg_days"))


def _yearly(star: Star) -> DataFrame:
    # ``anio`` is the fact's partition column: no join with the date dimension.
    return star.fact.groupBy("anio").agg(F.sum(_rev()).alias("rev"))


def q02_yoy(star: Star) -> DataFrame:
    """Revenue per year and growth over the previous year (LAG)."""
    w = Window.orderBy("anio")                      # one row per year
    y = _yearly(star).withColumn("prev", F.lag("rev").over(w))
    return y.select(
        F.col("anio").cast("int").alias("anio"),
        money(F.col("rev")).alias("revenue"),
        money(F.col("prev")).alias("prev_revenue"),
        pct(F.col("rev") - F.col("prev"), F.col("prev")).alias("growth_pct"))


def _daily(star: Star) -> DataFrame:
    return star.fact.groupBy("fecha_id").agg(F.sum(_rev()).alias("rev"))


def q03_running_month(star: Star) -> DataFrame:
    """Monthly revenue and its running total (SUM OVER)."""
    m = (_with_dates(star, _daily(star), "anio", "mes").groupBy("anio", "mes")
         .agg(F.sum("rev").alias("rev")))
    w = Window.orderBy("anio", "mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select(
        F.col("anio").cast("int").alias("anio"), F.col("mes").cast("int").alias("mes"),
        money(F.col("rev")).alias("revenue"),
        money(F.sum("rev").over(w)).alias("running_revenue"))


def q04_weekend(star: Star) -> DataFrame:
    """Weekend versus weekday sales."""
    per = star.fact.groupBy("fecha_id", _invoice_nonc().alias("invoice")).agg(F.sum(_rev()).alias("rev"))
    g = (_with_dates(star, per, "es_fin_semana").groupBy("es_fin_semana")
         .agg(F.count_distinct("invoice").alias("orders"), F.sum("rev").alias("rev")))
    return g.select(
        F.col("es_fin_semana").cast("int").alias("es_fin_semana"),
        F.col("orders").cast("bigint").alias("orders"),
        money(F.col("rev")).alias("revenue"),
        round2(ratio(F.col("rev"), F.col("orders"))).alias("revenue_per_order"))


# --- Group 2: sales ----------------------------------------------------------

def q05_month_rank(star: Star) -> DataFrame:
    """Calendar months ranked by revenue across all years (RANK)."""
    m = _with_dates(star, _daily(star), "mes").groupBy("mes").agg(F.sum("rev").alias("rev"))
    w = Window.orderBy(F.col("rev").desc_nulls_last())          # at most 12 rows
    return m.select(
        F.col("mes").cast("int").alias("mes"), money(F.col("rev")).alias("revenue"),
        F.rank().over(w).cast("bigint").alias("revenue_rank"))


def q05_month_rank_by_year(star: Star) -> DataFrame:
    """The months of each year ranked by revenue (RANK PARTITION BY year)."""
    m = (_with_dates(star, _daily(star), "anio", "mes").groupBy("anio", "mes")
         .agg(F.sum("rev").alias("rev")))
    w = Window.partitionBy("anio").orderBy(F.col("rev").desc_nulls_last())
    return m.select(
        F.col("anio").cast("int").alias("anio"), F.col("mes").cast("int").alias("mes"),
        money(F.col("rev")).alias("revenue"), F.rank().over(w).cast("bigint").alias("revenue_rank"))


def q06_ticket_quarter(star: Star) -> DataFrame:
    """Average invoice value per (year, quarter): invoice totals, then average."""
    per = star.fact.filter(_nonc()).groupBy("fecha_id", "invoice_number").agg(
        F.sum("total_linea").alias("ticket"))
    inv = (_with_dates(star, per, "anio", "trimestre").groupBy("anio", "trimestre", "invoice_number")
           .agg(F.sum("ticket").alias("ticket")))
    q = inv.groupBy("anio", "trimestre").agg(F.count(F.lit(1)).alias("orders"),
                                              F.sum("ticket").alias("tickets"))
    return q.select(
        F.col("anio").cast("int").alias("anio"), F.col("trimestre").cast("int").alias("trimestre"),
        F.col("orders").cast("bigint").alias("orders"),
        round2(ratio(F.col("tickets"), F.col("orders"))).alias("avg_ticket"))


def q07_cancel_impact(star: Star) -> DataFrame:
    """Economic impact of cancellations (conditional aggregation)."""
    canc = F.col("is_cancelled") == 1
    a = star.fact.agg(
        F.count_if(canc).alias("lines"),
        F.count_distinct(F.when(canc, F.col("invoice_number"))).alias("invoices"),
        (-F.sum(F.when(canc, F.col("total_linea")))).alias("value"),
        F.sum(_rev()).alias("rev"))
    return a.select(
        F.col("lines").cast("bigint").alias("cancelled_lines"),
        F.col("invoices").cast("bigint").alias("cancelled_invoices"),
        money(F.col("value")).alias("cancelled_value"),
        money(F.col("rev")).alias("revenue"),
        pct(F.col("value"), F.col("rev")).alias("pct_of_revenue"))


def _returns(star: Star) -> tuple[DataFrame, DataFrame]:
    """Lines with the units they hold or take, and the pairs; found once per opened star."""
    def make():
        lines = returns.consumption(star.fact)
        return lines, write_table(returns.matches(lines), scratch_path(star.fact.sparkSession, "returns"))
    return star.once("returns", make)


def q07_cancel_matches(star: Star) -> DataFrame:
    """Which sale each cancellation takes back, and how many units (first in, first out)."""
    return _returns(star)[1]


def q07_cancel_lines(star: Star) -> DataFrame:
    """Every fact line with its units that were taken back, or that it takes back, and whether that is all."""
    return returns.line_status(*_returns(star))


def q14_matched_returns(star: Star) -> DataFrame:
    """Per product: returned units, those that an earlier sale explains, their value at the price
    then paid, and the days between sale and return."""
    lines, pairs = _returns(star)
    line = star.fact.select("ventas_id", "producto_id", "precio_unitario", "fecha_id")
    days = _dim(star, "dim_fecha", "fecha_id", "fecha_completa")       # one row a day
    day = line.join(days, "fecha_id")
    sold = day.select(F.col("ventas_id").alias("sale_line"), "producto_id", "precio_unitario",
                      F.col("fecha_completa").alias("sold_on"))
    back = day.select(F.col("ventas_id").alias("cancel_line"), F.col("fecha_completa").alias("back_on"))
    pair = pairs.join(sold, "sale_line").join(back, "cancel_line")
    found = pair.groupBy("producto_id").agg(
        F.sum("units").alias("matched"), F.sum(F.col("units") * F.col("precio_unitario")).alias("value"),
        F.sum(F.col("units") * F.datediff("back_on", "sold_on")).alias("days"))
    per = lines.filter("is_cancelled = 1").groupBy("producto_id").agg(F.sum("units").alias("returned"))
    per = per.filter("returned > 0").join(found, "producto_id", "left")
    per = _join_dim(star, per, "dim_producto", "producto_id", "stock_code")
    matched = F.coalesce("matched", F.lit(0))
    return per.select(
        "stock_code", F.col("returned").cast("bigint").alias("returned_units"), matched.cast("bigint").alias("matched_units"),
        pct(matched, F.col("returned")).alias("matched_pct"), money(F.col("value")).alias("matched_value"),
        round2(ratio(F.col("days"), F.col("matched"))).alias("avg_days_to_return"))


def q08_hours(star: Star) -> DataFrame:
    """Orders per hour of day and share of all (% OVER)."""
    h = star.fact.groupBy("hora_venta").agg(F.count_distinct(_invoice_nonc()).alias("orders"))
    w = Window.partitionBy()                                     # at most 24 rows
    return h.select(
        F.col("hora_venta").cast("int").alias("hora_venta"),
        F.col("orders").cast("bigint").alias("orders"),
        pct(F.col("orders"), F.sum("orders").over(w)).alias("share_pct"))


# --- Group 3: customers -------------------------------------------------------

def _customer_revenue(star: Star) -> DataFrame:
    return star.fact.filter(_nonc()).groupBy("cliente_id").agg(
        F.sum("total_linea").alias("rev"),
        F.count_distinct("invoice_number").alias("orders"))


def q09_segment_share(star: Star) -> DataFrame:
    """Customers and revenue per segment, share of total (% OVER)."""
    per = star["dim_cliente"].select("cliente_id", "segmento").join(
        _customer_revenue(star).select("cliente_id", "rev"), "cliente_id", "left")
    s = per.groupBy("segmento").agg(F.count(F.lit(1)).alias("customers"),
                                     F.sum(F.coalesce(F.col("rev"), F.lit(0))).alias("rev"))
    w = Window.partitionBy()                                     # five segments
    return s.select(
        "segmento", F.col("customers").cast("bigint").alias("customers"),
        money(F.col("rev")).alias("revenue"),
        pct(F.col("rev"), F.sum("rev").over(w)).alias("share_pct"))


def q10_top_customers(star: Star) -> DataFrame:
    """Top 10 known customers by revenue (ROW_NUMBER)."""
    per = _customer_revenue(star).filter(known(star))
    w = Window.orderBy(F.col("rev").desc(), F.col("cliente_id"))
    top = per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 10)
    top = _join_dim(star, top, "dim_cliente", "cliente_id", "customer_id", "country", "segmento")
    return top.select(
        F.col("rank").cast("bigint").alias("rank"), "customer_id", "country", "segmento",
        money(F.col("rev")).alias("revenue"), F.col("orders").cast("bigint").alias("orders"))


def q11_new_customers(star: Star) -> DataFrame:
    """New known customers per month (first purchase) and the running total."""
    first = (star.fact.filter(_nonc() & known(star)).groupBy("cliente_id")
             .agg(F.min("fecha_id").alias("fecha_id")))
    m = _with_dates(star, first, "anio", "mes").groupBy("anio", "mes").agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("anio", "mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select(
        F.col("anio").cast("int").alias("anio"), F.col("mes").cast("int").alias("mes"),
        F.col("n").cast("bigint").alias("new_customers"),
        F.sum("n").over(w).cast("bigint").alias("cumulative_customers"))


def _order_days(star: Star) -> DataFrame:
    """One row per known customer and day with an order."""
    days = star.fact.filter(_nonc() & known(star)).select(F.col("cliente_id").alias("customer"), "fecha_id").distinct()
    return _with_dates(star, days, "fecha_completa").select("customer", F.col("fecha_completa").alias("day"))


def _months(star: Star) -> tuple[DataFrame, DataFrame, int]:
    """Month bitmaps of the known customers, the calendar's first month, and how many months it has."""
    first, last = star["dim_fecha"].agg(F.min("fecha_completa"), F.max("fecha_completa")).first()
    if first is None:
        first = last = datetime.date(1970, 1, 1)
    number = (F.year("day") - first.year) * 12 + F.month("day") - first.month
    months = (last.year - first.year) * 12 + last.month - first.month + 1
    return retention.month_bitmaps(_order_days(star).withColumn("month", number), months), first, months


def _month_start(first, number: Column) -> tuple[Column, Column]:
    at = number + F.lit(first.year * 12 + first.month - 1)
    return F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int")


def q11_cohorts(star: Star) -> DataFrame:
    """Cohort matrix: of the customers who first bought in a month, how many buy again k months later."""
    bitmaps, first, months = _months(star)
    c = retention.cohorts(bitmaps, months)
    size = Window.partitionBy("first")                              # one row per cohort and month
    year, month = _month_start(first, F.col("first"))
    return c.withColumn("cohort", F.max(F.when(F.col("later") == 0, F.col("customers"))).over(size)).select(
        year.alias("anio"), month.alias("mes"), F.col("later").cast("int").alias("months_later"),
        F.col("customers").cast("bigint").alias("customers"), pct(F.col("customers"), F.col("cohort")).alias("retention_pct"))


def q12_active_months(star: Star) -> DataFrame:
    """In how many different months customers buy."""
    return retention.active_months(_months(star)[0]).select(
        F.col("active_months").cast("int").alias("active_months"), F.col("customers").cast("bigint").alias("customers"))


def q12_rolling_active(star: Star) -> DataFrame:
    """For every day of the calendar the known customers with an order in the 30 days up to it."""
    calendar = star["dim_fecha"].select(F.col("fecha_completa").alias("day"))
    return retention.rolling_active(_order_days(star), calendar, fixed.ACTIVE_DAYS).select(
        F.date_format("day", "yyyy-MM-dd").alias("fecha"), F.col("active").cast("bigint").alias("active_customers"))


def customer_history(star: Star) -> DataFrame:
    """Customers' countries over time, as intervals of validity."""
    found = history.country_intervals(star.fact, star["dim_fecha"])
    found = _join_dim(star, found, "dim_geografia", "geografia_id", "country")
    found = found.join(star["dim_cliente"].select("cliente_id", "customer_id"), "cliente_id")
    return found.select("customer_id", F.col("version").cast("int").alias("version"), "country",
                        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
                        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def sales_by_valid_country(star: Star) -> DataFrame:
    """Lines and revenue by the country that was valid for their customer on the day, and how many lines name another one."""
    intervals = write_table(history.country_intervals(star.fact, star["dim_fecha"]),
                            scratch_path(star.fact.sparkSession, "country-intervals"))
    # Lines of one customer, day and country find the same interval: they are summed up first.
    per = star.fact.groupBy("cliente_id", "fecha_id", "geografia_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(_rev()).alias("rev"))
    per = _with_dates(star, per, "fecha_completa")
    last = star["dim_fecha"].agg(F.max("fecha_completa"))
    elsewhere = F.when(F.col("geografia_id") != F.col("valid_geografia"), F.col("lines")).otherwise(F.lit(0))
    found = history.valid_at(per, intervals, "fecha_completa", last).groupBy("valid_geografia").agg(
        F.sum("lines").alias("lines"), F.sum("rev").alias("rev"), F.sum(elsewhere).alias("elsewhere"))
    found = _join_dim(star, found.withColumnRenamed("valid_geografia", "geografia_id"), "dim_geografia", "geografia_id", "country")
    return found.select("country", F.col("lines").cast("bigint").alias("lines"), money(F.col("rev")).alias("revenue"),
                        F.col("elsewhere").cast("bigint").alias("lines_elsewhere"))


def q12_recurrent(star: Star) -> DataFrame:
    """Share of known buying customers with two or more orders."""
    per = _customer_revenue(star).filter(known(star))
    a = per.agg(F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("orders") >= 2).alias("rec"))
    return a.select(
        F.col("buyers").cast("bigint").alias("customers_with_orders"),
        F.col("rec").cast("bigint").alias("recurrent_customers"),
        pct(F.col("rec"), F.col("buyers")).alias("recurrent_pct"))


# --- Group 4: products --------------------------------------------------------

def _product_sales(star: Star) -> DataFrame:
    return star.fact.filter(_nonc()).groupBy("producto_id").agg(
        F.sum("total_linea").alias("rev"), F.sum("cantidad").cast("bigint").alias("units"))


def q13_top_products(star: Star) -> DataFrame:
    """Top 10 products by revenue, with their rank by units as well (double RANK).

    The top 10 come first. Their rank by units is one more than the number of
    products with more units, from the counts per distinct number of units;
    a number that half of the products share is one row there.
    """
    sales = _product_sales(star)
    w = Window.orderBy(F.col("rev").desc())
    top = sales.withColumn("revenue_rank", F.rank().over(w)).filter(F.col("revenue_rank") <= 10)
    counts = sales.groupBy(F.col("units").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    # NULL units rank last, behind every number.
    above = (F.col("u") > F.col("units")) | (F.col("u").isNotNull() & F.col("units").isNull())
    # Ten rows (and their ties) go to the counts, not the counts to them.
    rank = (counts.join(F.broadcast(top.select("producto_id", "units")), above)
            .groupBy("producto_id").agg(F.sum("n").alias("ahead")))
    top = (top.join(rank, "producto_id", "left")
           .withColumn("units_rank", F.coalesce("ahead", F.lit(0)) + 1))
    top = _join_dim(star, top, "dim_producto", "producto_id", "stock_code", "descripcion")
    return top.select(
        "stock_code", "descripcion", money(F.col("rev")).alias("revenue"),
        F.col("units").cast("bigint").alias("units"),
        F.col("revenue_rank").cast("bigint").alias("revenue_rank"),
        F.col("units_rank").cast("bigint").alias("units_rank"))


def q14_return_rate(star: Star) -> DataFrame:
    """Returned units over sold units per product (products with returns)."""
    canc = F.col("is_cancelled") == 1
    p = star.fact.groupBy("producto_id").agg(
        F.sum(F.when(_nonc(), F.col("cantidad"))).alias("sold"),
        (-F.sum(F.when(canc, F.col("cantidad")))).alias("returned"))
    p = p.filter(F.col("returned") > 0)
    p = _join_dim(star, p, "dim_producto", "producto_id", "stock_code")
    return p.select(
        "stock_code", F.col("sold").cast("bigint").alias("sold_units"),
        F.col("returned").cast("bigint").alias("returned_units"),
        pct(F.col("returned"), F.col("sold")).alias("return_rate_pct"))


def q15_pareto(star: Star) -> DataFrame:
    """Products that make up the first 80% of revenue (cumulative, Pareto).

    A product is kept when the revenue ranked before it is under 80% of the
    total, so the product that crosses 80% is included. The comparison is
    exact: 5 * before < 4 * total in DECIMAL.
    """
    sales = _product_sales(star).select("producto_id", "rev")
    total = F.col("total")
    cum = with_running_sum(sales, [F.col("rev").desc(), F.col("producto_id")], "rev", "cum",
                           rn_name="rank", total_name="total")
    kept = cum.filter((F.col("cum") - F.col("rev")) * 5 < total * 4)
    kept = _join_dim(star, kept, "dim_producto", "producto_id", "stock_code")
    return kept.select(
        F.col("rank").cast("bigint").alias("rank"), "stock_code",
        money(F.col("rev")).alias("revenue"),
        money(F.col("cum")).alias("cumulative_revenue"),
        pct(F.col("cum"), total).alias("cumulative_pct"))


def q16_price_vs_ref(star: Star) -> DataFrame:
    """Average selling price per product against its reference price."""
    p = star.fact.filter(_nonc()).groupBy("producto_id").agg(
        F.sum("precio_unitario").alias("s"), F.count(F.lit(1)).alias("n"))
    p = _join_dim(star, p, "dim_producto", "producto_id", "stock_code", "precio_referencia")
    ref_total = F.col("precio_referencia") * F.col("n")
    return p.select(
        "stock_code",
        round2(ratio(F.col("s"), F.col("n"))).alias("avg_price"),
        money(F.col("precio_referencia")).alias("reference_price"),
        pct(F.col("s") - ref_total, ref_total).alias("gap_pct"))


def _list_prices(star: Star) -> DataFrame:
    """The price list: per product and day the highest unit price asked."""
    return (star.fact.filter(_nonc()).groupBy("producto_id", "fecha_id").agg(F.max("precio_unitario").alias("list_price")))


def q16_price_asof(star: Star) -> DataFrame:
    """Selling prices against the list price that stood when the line was sold.

    The list price of a product changes with every day it sells; a line is
    compared with the last one of an earlier day (as-of join), lines of a product's
    first day with none.
    """
    sold = star.fact.filter(_nonc()).select("ventas_id", "producto_id", "fecha_id", "precio_unitario")
    lines = asof_join(sold, _list_prices(star), ["producto_id"], "fecha_id", F.col("list_price"), "asof_price",
                      ["ventas_id"], strict=True, name="price")
    has = F.col("asof_price").isNotNull()
    p = lines.groupBy("producto_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has).alias("priced"),
        F.sum(F.when(has, F.col("precio_unitario"))).alias("s"), F.sum("asof_price").alias("ref"),
        F.count_if(F.col("precio_unitario") > F.col("asof_price")).alias("above"),
        F.count_if(F.col("precio_unitario") < F.col("asof_price")).alias("below"))
    p = _join_dim(star, p, "dim_producto", "producto_id", "stock_code")
    return p.select(
        "stock_code", F.col("n").cast("bigint").alias("lines"), F.col("priced").cast("bigint").alias("priced_lines"),
        F.col("above").cast("bigint").alias("above_lines"), F.col("below").cast("bigint").alias("below_lines"),
        round2(ratio(F.col("s"), F.col("priced"))).alias("avg_price"),
        round2(ratio(F.col("ref"), F.col("priced"))).alias("avg_asof_price"),
        pct(F.col("s") - F.col("ref"), F.col("ref")).alias("gap_pct"))


# --- Group 5: geography and trends --------------------------------------------

def q17_geo_share(star: Star) -> DataFrame:
    """Revenue per country: share of the total and share within its region.

    The total is a scalar subquery (one value), so country rows are never
    gathered into one task; the regional total is a window per region.
    """
    c = star.fact.filter(_nonc()).groupBy("geografia_id").agg(F.sum("total_linea").alias("rev"))
    total = c.agg(F.sum("rev")).scalar()
    c = _join_dim(star, c, "dim_geografia", "geografia_id", "country", "region")
    region = Window.partitionBy("region")
    return c.select(
        "country", "region", money(F.col("rev")).alias("revenue"),
        pct(F.col("rev"), total).alias("share_total_pct"),
        pct(F.col("rev"), F.sum("rev").over(region)).alias("share_region_pct"))


def q18_top3_country(star: Star) -> DataFrame:
    """Top 3 products per country (ROW_NUMBER PARTITION BY country).

    The rank filter becomes a WindowGroupLimit: each task keeps its local
    top 3 per country before the shuffle, so a dominant country sends
    3 rows per task, not all its products.
    """
    cp = (star.fact.filter(_nonc()).groupBy("geografia_id", "producto_id")
          .agg(F.sum("total_linea").alias("rev")))
    w = Window.partitionBy("geografia_id").orderBy(F.col("rev").desc(), F.col("producto_id"))
    top = cp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 3)
    top = _join_dim(star, top, "dim_geografia", "geografia_id", "country")
    top = _join_dim(star, top, "dim_producto", "producto_id", "stock_code")
    return top.select("country", F.col("rank").cast("bigint").alias("rank"), "stock_code",
                      money(F.col("rev")).alias("revenue"))


def q19_region_yoy(star: Star) -> DataFrame:
    """Revenue per region and year, growth within each region (LAG PARTITION BY)."""
    rg = star.fact.filter(_nonc()).groupBy("geografia_id", "anio").agg(
        F.sum("total_linea").alias("rev"))          # ``anio`` is on the fact: no date join
    rg = _join_dim(star, rg, "dim_geografia", "geografia_id", "region")
    y = rg.groupBy("region", "anio").agg(F.sum("rev").alias("rev"))
    w = Window.partitionBy("region").orderBy("anio")
    y = y.withColumn("prev", F.lag("rev").over(w))
    return y.select(
        "region", F.col("anio").cast("int").alias("anio"),
        money(F.col("rev")).alias("revenue"), money(F.col("prev")).alias("prev_revenue"),
        pct(F.col("rev") - F.col("prev"), F.col("prev")).alias("growth_pct"))


def q17_subtotals(star: Star) -> DataFrame:
    """Revenue and lines by country, region and year with all subtotals, in one pass (GROUPING SETS).

    The fact is reduced to a row per country and year before the sets multiply it.
    """
    per = star.fact.groupBy("geografia_id", "anio").agg(F.sum(_rev()).alias("rev"), F.count(F.lit(1)).alias("n"))
    per = _join_dim(star, per, "dim_geografia", "geografia_id", "country", "region")
    region, country, year = F.col("region"), F.col("country"), F.col("anio")
    sets = [[region, country, year], [region, country], [region, year], [region], [year], []]
    g = per.groupingSets(sets, region, country, year).agg(
        F.grouping_id().alias("level"), F.sum("rev").alias("rev"), F.sum("n").alias("n"))
    return g.select(F.col("level").cast("int").alias("level"), "region", "country", F.col("anio").cast("int").alias("anio"),
                    money(F.col("rev")).alias("revenue"), F.col("n").cast("bigint").alias("lines"))


def q20_rfm(star: Star) -> DataFrame:
    """RFM profile of known buying customers: NTILE(5) per measure + label.

    Recency = days from the customer's last order to the last order date
    overall, plus one. R tiles by recency descending (most recent -> 5),
    F and M ascending; ties broken by customer id.

    The per-customer measures are written once. Of each measure, the first
    row of the tiles 2 to 5 is found; these 12 rows are all it takes to score
    every customer in one projection, without joining anything back.
    """
    spark = star.fact.sparkSession
    per = (star.fact.filter(_nonc() & known(star)).groupBy("cliente_id").agg(
        F.max("fecha_id").alias("fecha_id"),
        F.count_distinct("invoice_number").alias("frequency"),
        F.sum("total_linea").alias("monetary")))
    per = _with_dates(star, per, "fecha_completa")
    ref = per.agg(F.max("fecha_completa")).scalar()
    per = per.select("cliente_id", "frequency", "monetary", (
        F.datediff(ref, F.col("fecha_completa")) + 1).cast("bigint").alias("recency_days"))
    per = write_table(per, scratch_path(spark, "rfm-measures"))

    def tile(name: str, measure: str, descending: bool) -> Column:
        value, key = F.col(measure), F.col("cliente_id")
        cuts = ntile_cuts(per.select("cliente_id", measure), [value.desc() if descending else value, key],
                          fixed.RFM_BUCKETS)
        score = F.lit(1)
        for cut in cuts:
            at = F.lit(cut[measure])
            past = (value < at) if descending else (value > at)
            score = score + (past | ((value == at) & (key >= cut["cliente_id"]))).cast("int")
        return score.alias(name)

    per = per.select("*", tile("r_score", "recency_days", True), tile("f_score", "frequency", False),
                     tile("m_score", "monetary", False))

    score = F.col("r_score") + F.col("f_score") + F.col("m_score")
    label = F.lit(fixed.RFM_LABEL_REST)
    for threshold, name in reversed(fixed.RFM_LABELS):
        label = F.when(score >= threshold, F.lit(name)).otherwise(label)
    per = _join_dim(star, per, "dim_cliente", "cliente_id", "customer_id")
    return per.select(
        "customer_id", F.col("recency_days").cast("bigint").alias("recency_days"),
        F.col("frequency").cast("bigint").alias("frequency"),
        money(F.col("monetary")).alias("monetary"),
        F.col("r_score").cast("bigint").alias("r_score"),
        F.col("f_score").cast("bigint").alias("f_score"),
        F.col("m_score").cast("bigint").alias("m_score"),
        score.cast("bigint").alias("rfm_score"), label.alias("rfm_segment"))


# --- Dashboard metrics ----------------------------------------------------------

def k1_vip_concentration(star: Star) -> DataFrame:
    """VIP customers, their revenue share and revenue per VIP customer."""
    per = star["dim_cliente"].select("cliente_id", "segmento").join(
        _customer_revenue(star).select("cliente_id", "rev"), "cliente_id", "left")
    vip = F.col("segmento") == fixed.SEGMENT_VIP
    a = per.agg(F.count_if(vip).alias("n"), F.sum(F.when(vip, F.col("rev"))).alias("vip_rev"),
                F.sum("rev").alias("rev"))
    return a.select(
        F.col("n").cast("bigint").alias("vip_customers"),
        money(F.col("vip_rev")).alias("vip_revenue"),
        pct(F.col("vip_rev"), F.col("rev")).alias("vip_share_pct"),
        round2(ratio(F.col("vip_rev"), F.col("n"))).alias("revenue_per_vip"))


def k2_market_gap(star: Star) -> DataFrame:
    """Leading market's share and how far ahead of the second it is."""
    c = star.fact.filter(_nonc()).groupBy("geografia_id").agg(F.sum("total_linea").alias("rev"))
    total = c.agg(F.sum("rev")).scalar()
    w = Window.orderBy(F.col("rev").desc(), F.col("geografia_id"))
    top2 = c.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 2)
    top2 = _join_dim(star, top2, "dim_geografia", "geografia_id", "country")
    a = top2.agg(
        F.max(F.when(F.col("pos") == 1, F.col("country"))).alias("top_country"),
        F.max(F.when(F.col("pos") == 1, F.col("rev"))).alias("r1"),
        F.max(F.when(F.col("pos") == 2, F.col("country"))).alias("second_country"),
        F.max(F.when(F.col("pos") == 2, F.col("rev"))).alias("r2"))
    return a.select(
        "top_country", money(F.col("r1")).alias("top_revenue"),
        pct(F.col("r1"), total).alias("top_share_pct"),
        "second_country", money(F.col("r2")).alias("second_revenue"),
        round2(ratio(F.col("r1"), F.col("r2"))).alias("gap_ratio"))


def k3_top5_share(star: Star) -> DataFrame:
    """Revenue share of the five best-selling products."""
    sales = _product_sales(star).select("producto_id", "rev")
    total = sales.agg(F.sum("rev")).scalar()
    w = Window.orderBy(F.col("rev").desc(), F.col("producto_id"))
    top = sales.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 5)
    a = top.agg(F.sum("rev").alias("top5"))
    return a.select(money(F.col("top5")).alias("top5_revenue"),
                    money(total).alias("total_revenue"),
                    pct(F.col("top5"), total).alias("top5_share_pct"))


def k4_business_hours(star: Star) -> DataFrame:
    """Share of orders placed during office hours (10:00-15:00)."""
    lo, hi = fixed.BUSINESS_HOURS
    in_hours = (F.col("hora_venta") >= lo) & (F.col("hora_venta") < hi)
    invoices = star.fact.filter(_nonc() & F.col("invoice_number").isNotNull()).groupBy(
        "invoice_number").agg(F.max(in_hours.cast("int")).alias("inside"))
    a = invoices.agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"), F.count(F.lit(1)).alias("orders"))
    return a.select(F.col("inside").cast("bigint").alias("orders_in_hours"),
                    F.col("orders").cast("bigint").alias("orders"),
                    pct(F.col("inside"), F.col("orders")).alias("share_pct"))


ANALYTIC = {
    "q01_kpis": q01_kpis, "q01_sketch_ranges": q01_sketch_ranges, "removed_duplicates": removed_duplicates,
    "q08_sessions": q08_sessions, "q02_yoy": q02_yoy, "q03_running_month": q03_running_month,
    "q04_weekend": q04_weekend, "q05_month_rank": q05_month_rank,
    "q05_month_rank_by_year": q05_month_rank_by_year,
    "q06_ticket_quarter": q06_ticket_quarter, "q07_cancel_impact": q07_cancel_impact,
    "q07_cancel_matches": q07_cancel_matches, "q07_cancel_lines": q07_cancel_lines,
    "q08_hours": q08_hours, "q09_segment_share": q09_segment_share,
    "q10_top_customers": q10_top_customers, "q11_new_customers": q11_new_customers,
    "q11_cohorts": q11_cohorts, "q12_active_months": q12_active_months,
    "q12_rolling_active": q12_rolling_active, "customer_history": customer_history,
    "sales_by_valid_country": sales_by_valid_country, "q17_subtotals": q17_subtotals,
    "q12_recurrent": q12_recurrent, "q13_top_products": q13_top_products,
    "q14_return_rate": q14_return_rate, "q14_matched_returns": q14_matched_returns,
    "q15_pareto": q15_pareto, "q16_price_vs_ref": q16_price_vs_ref, "q16_price_asof": q16_price_asof,
    "q17_geo_share": q17_geo_share,
    "q18_top3_country": q18_top3_country, "q19_region_yoy": q19_region_yoy,
    "q20_rfm": q20_rfm,
    "k1_vip_concentration": k1_vip_concentration, "k2_market_gap": k2_market_gap,
    "k3_top5_share": k3_top5_share, "k4_business_hours": k4_business_hours,
}
