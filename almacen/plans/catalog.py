"""Every registered operator as ``(spark, sf_dir) -> DataFrame``.

All of them read the driver tables through the warehouse build for
``sf_dir`` (built once, then reused) and run over the whole data.

For the result comparison, dates and timestamps are rendered as ISO text
and DECIMAL money as DOUBLE; the stored tables keep their declared types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import audit, profile
from ..operators import clean as clean_ops
from ..operators import dims as dim_ops
from ..operators import fact as fact_ops
from ..operators.stage import wall_clock
from ..plans import queries, refresh, warehouse
from ..plans.warehouse import Star, star
from ..session import scratch_path
from ..sources.csv import csv_scan


def _staged_view(df: DataFrame, with_total: bool = False) -> DataFrame:
    cols = ["invoice", "stock_code", "description", "quantity",
            F.col("invoice_date").cast("string").alias("invoice_date"), "price",
            "customer_id", "country", "is_cancelled"]
    if with_total:
        cols.append(F.col("total_line").cast("double").alias("total_line"))
    return df.select(*cols)


def access_paths(s: Star) -> DataFrame:
    """A look-up by each declared access path, for the middle member of its dimension: the
    lines found, and whether the look-up opened less than a fifth of the files. Of paths with few
    values (flag, month, segment, region) a value's own share may be more, so they only find."""
    spark, a = s.fact.sparkSession, s.access
    middle = {c: (s.tables[t].agg(F.max(c)).first()[0] or 0) // 2 + 1 for t, c in
              (("dim_cliente", "cliente_id"), ("dim_producto", "producto_id"), ("dim_geografia", "geografia_id"),
               ("dim_fecha", "fecha_id"))}
    day = s["dim_fecha"].filter(F.col("fecha_id") == middle["fecha_id"]).first()
    place = s["dim_geografia"].filter(F.col("geografia_id") == middle["geografia_id"]).first()
    asked = [("fact_by_date", {"fecha_id": middle["fecha_id"]}, False)]
    asked += [("fact_ventas", {c: middle[c]}, True) for c in ("cliente_id", "producto_id", "geografia_id")]
    asked += [("fact_ventas", {"is_cancelled": 1}, False), ("dim_cliente", {"segmento": fixed.SEGMENT_VIP}, False)]
    if day:
        asked.append(("dim_fecha", {"anio": day["anio"], "mes": day["mes"]}, False))
    if place:
        asked.append(("dim_geografia", {"region": place["region"]}, False))
    out = None
    for table, keys, point in asked:
        seen = a[table].report(**keys)
        few = F.lit(5 * seen["files_read"] < seen["files"] if point else None).cast("boolean")
        found = a[table].lookup(**keys).agg(
            F.lit(",".join(keys)).alias("path"), F.lit(",".join(map(str, keys.values()))).alias("wanted"),
            F.count(F.lit(1)).alias("rows"), few.alias("under_a_fifth"))
        out = found if out is None else out.unionByName(found)
    return out.select("path", "wanted", F.col("rows").cast("bigint").alias("rows"), "under_a_fifth")


def _refreshed(s: Star) -> Star:
    """A star of an earlier feed, brought up to the present one: then, the lines of the last year
    were still missing, and those of the first year had another price."""
    def make() -> Star:
        spark = s.fact.sparkSession
        first, last = s["dim_fecha"].agg(F.min("anio"), F.max("anio")).first()
        year = F.coalesce(F.year(wall_clock("InvoiceDate", s.ts_format)), F.lit(warehouse.NO_YEAR))
        earlier = s.landing.filter(year != F.lit(last)).withColumn(
            "Price", F.when(year == F.lit(first), F.lit("9.99")).otherwise(F.col("Price")))
        base = scratch_path(spark, "refresh")
        warehouse.build(spark, None, base=base, raw=earlier, ts_format=s.ts_format)
        return refresh.refresh(spark, base, raw=s.landing, ts_format=s.ts_format)
    return s.once("refreshed", make)


def refresh_years(s: Star) -> DataFrame:
    """The fact after a refresh, by year, and which years the refresh rewrote."""
    now = _refreshed(s)
    return now.fact.groupBy("anio").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.when(F.col("is_cancelled") == 0, F.col("total_linea"))).alias("revenue")).select(
        F.col("anio").cast("int").alias("anio"), "lines", F.col("revenue").cast("double").alias("revenue"),
        F.col("anio").isin(refresh.rewritten(now)).alias("rewritten"))


def refresh_members(s: Star) -> DataFrame:
    """The customers, products and countries after a refresh, by their natural keys."""
    t = _refreshed(s).tables
    return (t["dim_cliente"].select(F.lit("cliente").alias("dimension"), F.col("customer_id").alias("member"),
                                    F.concat_ws("|", "country", "segmento", "num_facturas").alias("attributes"))
            .unionByName(t["dim_producto"].select(F.lit("producto").alias("dimension"), F.col("stock_code").alias("member"),
                                                  F.concat_ws("|", "descripcion", F.col("precio_referencia").cast("string"))
                                                  .alias("attributes")))
            .unionByName(t["dim_geografia"].select(F.lit("geografia").alias("dimension"), F.col("country").alias("member"),
                                                   F.col("region").alias("attributes"))))


def refresh_fact(s: Star) -> DataFrame:
    """The fact after a refresh, with natural keys in place of surrogate ones."""
    now = _refreshed(s)
    t = now.tables
    return (now.fact.join(t["dim_fecha"].select("fecha_id", "fecha_completa"), "fecha_id")
            .join(t["dim_cliente"].select("cliente_id", "customer_id"), "cliente_id")
            .join(t["dim_producto"].select("producto_id", "stock_code"), "producto_id")
            .join(t["dim_geografia"].select("geografia_id", "country"), "geografia_id")
            .select("invoice_number", F.date_format("fecha_completa", "yyyy-MM-dd").alias("fecha"), "hora_venta", "customer_id",
                    "stock_code", "country", "cantidad", F.col("precio_unitario").cast("double").alias("precio_unitario"),
                    F.col("total_linea").cast("double").alias("total_linea"), "is_cancelled"))


def _etl(s: Star) -> dict[str, Callable[[], DataFrame]]:
    t = s.tables
    return {
        # sources
        "csv_scan": lambda: csv_scan(s.landing.sparkSession, s.landing_path, s.multi_line),
        # profile of the raw feed
        "null_profile": lambda: profile.null_profile(s.landing),
        "dup_count": lambda: profile.duplicate_count(s.landing),
        "cancel_count": lambda: profile.cancel_count(s.landing),
        "neg_qty_count": lambda: profile.negative_quantity_count(s.landing),
        "zero_price_count": lambda: profile.zero_price_count(s.landing),
        "irregular_codes": lambda: profile.irregular_codes(s.landing),
        "country_counts": lambda: profile.country_counts(s.landing),
        "multi_country_customers": lambda: profile.multi_country_customers(s.landing),
        # standardise and clean
        "staged_lines": lambda: _staged_view(s.staged),
        "clean_lines": lambda: _staged_view(s.clean, with_total=True),
        "cleaning_ledger": lambda: clean_ops.ledger(s.staged, s.tagged, s.quarantine),
        # dimensions
        "dim_fecha": lambda: t["dim_fecha"].withColumn(
            "fecha_completa", F.date_format("fecha_completa", "yyyy-MM-dd")),
        "dim_cliente": lambda: t["dim_cliente"],
        "dim_cliente_documented": lambda: dim_ops.dim_cliente_documented(t["dim_cliente"]),
        "modal_description": lambda: dim_ops.modal_description(s.clean),
        "median_price": lambda: dim_ops.median_price(s.clean).select(
            "stock_code", F.col("precio_mediano").cast("double").alias("precio_mediano")),
        "dim_producto": lambda: t["dim_producto"].withColumn(
            "precio_referencia", F.col("precio_referencia").cast("double")),
        "dim_geografia": lambda: t["dim_geografia"],
        "dim_distribution": lambda: profile.dim_distribution(t["dim_cliente"], t["dim_geografia"]),
        # fact and load
        "fact_ventas": lambda: s.fact.drop("anio").withColumn(
            "precio_unitario", F.col("precio_unitario").cast("double")).withColumn(
            "total_linea", F.col("total_linea").cast("double")),
        "net_revenue": lambda: fact_ops.net_revenue(s.fact).select(
            F.col("revenue").cast("double").alias("revenue")),
        "layout": lambda: s.fact.groupBy(F.col("anio").cast("int").alias("anio")).agg(
            F.count(F.lit(1)).alias("lines")),
        "access_paths": lambda: access_paths(s),
        "refresh_years": lambda: refresh_years(s),
        "refresh_members": lambda: refresh_members(s),
        "refresh_fact": lambda: refresh_fact(s),
        "warehouse_summary": lambda: profile.warehouse_summary(
            {k: (v.drop("anio") if k == "fact_ventas" else v) for k, v in t.items()}),
        # audits
        "audit_pk": lambda: audit.audit_pk(t),
        "audit_notnull": lambda: audit.audit_notnull(t, audit.held_back(s.rejected, s.quarantine)),
        "audit_fk": lambda: audit.audit_fk(t),
        "audit_bounds": lambda: audit.audit_bounds(t, audit.held_back(s.rejected, s.quarantine)),
    }


ETL_NAMES = [
    # sources and raw-feed profile
    "csv_scan", "null_profile", "dup_count", "cancel_count", "neg_qty_count", "zero_price_count",
    "irregular_codes", "country_counts", "multi_country_customers",
    # standardise and clean
    "staged_lines", "clean_lines", "cleaning_ledger",
    # dimensions
    "dim_fecha", "dim_cliente", "dim_cliente_documented", "modal_description", "median_price",
    "dim_producto", "dim_geografia", "dim_distribution",
    # fact, load and layout
    "fact_ventas", "net_revenue", "layout", "access_paths", "warehouse_summary",
    "refresh_years", "refresh_members", "refresh_fact",
    # audits
    "audit_pk", "audit_notnull", "audit_fk", "audit_bounds",
]


def _etl_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _etl(star(spark, sf_dir))[name]()
    run.__name__ = name
    return run


def _analytic_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = queries.ANALYTIC[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(star(spark, sf_dir))
        return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
                           for c, t in df.dtypes])
    run.__name__ = name
    return run


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _etl_query(n) for n in ETL_NAMES}
    out.update({n: _analytic_query(n) for n in queries.ANALYTIC})
    return out
