"""Reference SQL for the correctness gate (DuckDB dialect).

Each entry recomputes the whole pipeline from the driver tables in plain
SQL - derived feed, staging, de-duplication, removal rules, dimensions with
``row_number`` keys, fact - and then the question, written independently of
the Spark plans (global windows, NTILE, ordered aggregates), with the same
output names and types. Ties use the natural keys (customer id, stock code,
country) where the Spark plans use the equivalent surrogate keys.
"""

from __future__ import annotations

from ..functions import fixed
from ..sources.feed import FIXTURE_COUNTRIES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r2(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100.0 + 0.5) / 100.0)"


def ratio(a: str, b: str) -> str:
    return f"({dbl(a)} / nullif({dbl(b)}, 0.0))"


def pct(a: str, b: str) -> str:
    return r2(f"(CAST(100.0 AS DOUBLE) * {dbl(a)}) / nullif({dbl(b)}, 0.0)")


_COUNTRY_CASE = "CASE n_nationkey " + " ".join(
    f"WHEN {k} THEN {_q(v)}" for k, v in FIXTURE_COUNTRIES) + " ELSE n_name END"
_SPECIAL = ", ".join(_q(c) for c in fixed.SPECIAL_CODES)
_REGIONS = ", ".join(f"({_q(c)}, {_q(r)})" for c, r in fixed.REGIONS.items())
_STRIP = r"'^\s+|\s+$'"
_CANC = "(l_returnflag = 'R' OR o_custkey % 50 = 7)"

PRELUDE = f"""
WITH feed_base AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_returnflag,
         o.o_orderdate, o.o_custkey, n.n_nationkey, n.n_name, p.p_name, p.p_retailprice,
         l.l_orderkey * 7 + l.l_linenumber AS h
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey),
feed_rows AS (
  SELECT concat(CASE WHEN {_CANC} THEN 'C' ELSE '' END, CAST(500000 + l_orderkey AS VARCHAR)) AS "Invoice",
    CASE WHEN l_partkey % 97 = 0 THEN 'POST' WHEN l_partkey % 97 = 1 THEN 'm'
         WHEN l_partkey % 97 = 2 THEN 'DCGS0001' ELSE CAST(10000 + l_partkey AS VARCHAR) END AS "StockCode",
    CASE WHEN h % 53 = 0 THEN NULL WHEN h % 7 = 0 THEN concat('  ', p_name, ' ')
         WHEN h % 3 = 0 THEN concat(p_name, ' set') ELSE p_name END AS "Description",
    CAST(CASE WHEN {_CANC} THEN -CAST(l_quantity AS INTEGER)
              WHEN h % 101 = 0 THEN -CAST(l_quantity AS INTEGER)
              ELSE CAST(l_quantity AS INTEGER) END AS VARCHAR) AS "Quantity",
    CASE WHEN h % 997 = 0 THEN 'not-a-date'
         ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' ',
                     lpad(CAST(l_orderkey % 24 AS VARCHAR), 2, '0'), ':00:00') END AS "InvoiceDate",
    CASE WHEN h % 89 = 0 THEN '0.00'
         ELSE CAST(CAST(CAST(p_retailprice AS DECIMAL(10,2)) + l_linenumber AS DECIMAL(10,2)) AS VARCHAR)
    END AS "Price",
    CASE WHEN l_orderkey % 5 = 0 OR (o_custkey % 10 = 3 AND l_orderkey % 4 <> 1) THEN NULL
         ELSE concat(CAST(10000 + o_custkey AS VARCHAR), '.0') END AS "Customer ID",
    CASE WHEN l_orderkey % 211 = 0 THEN 'Unspecified' ELSE {_COUNTRY_CASE} END AS "Country",
    h
  FROM feed_base),
raw AS (
  SELECT "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country" FROM feed_rows
  UNION ALL
  SELECT "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country" FROM feed_rows WHERE h % 31 = 0
  UNION ALL
  SELECT "Invoice", "StockCode", upper("Description"), "Quantity", "InvoiceDate", "Price", "Customer ID", "Country" FROM feed_rows WHERE h % 37 = 0),
staged AS (
  SELECT "Invoice" AS invoice, "StockCode" AS stock_code,
    upper(regexp_replace(coalesce("Description", {_q(fixed.NO_DESCRIPTION)}), {_STRIP}, '', 'g')) AS description,
    TRY_CAST("Quantity" AS DOUBLE) AS quantity,
    TRY_STRPTIME("InvoiceDate", '%Y-%m-%d %H:%M:%S') AS invoice_date,
    TRY_CAST("Price" AS DOUBLE) AS price,
    regexp_replace(regexp_replace(coalesce("Customer ID", {_q(fixed.UNKNOWN_CUSTOMER)}), '\\.0$', ''),
                   {_STRIP}, '', 'g') AS customer_id,
    "Country" AS country,
    CASE WHEN starts_with("Invoice", 'C') THEN 1 ELSE 0 END AS is_cancelled
  FROM raw),
dedup AS (SELECT DISTINCT * FROM staged),
tagged AS (
  SELECT *, CASE WHEN stock_code IN ({_SPECIAL}) THEN 'special_code'
                 WHEN price <= 0 AND is_cancelled = 0 THEN 'price'
                 WHEN quantity <= 0 AND is_cancelled = 0 THEN 'quantity'
                 WHEN invoice_date IS NULL THEN 'date' END AS rule
  FROM dedup),
clean AS (
  SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country,
         is_cancelled, CAST(round(CAST(quantity AS DECIMAL(18,6)) * CAST(price AS DECIMAL(18,6)), 2)
                            AS DECIMAL(18,2)) AS total_line
  FROM tagged WHERE rule IS NULL),
dim_fecha AS (
  SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS fecha_id, d AS fecha_completa,
    CAST(year(d) AS SMALLINT) AS anio, CAST(quarter(d) AS SMALLINT) AS trimestre,
    CAST(month(d) AS SMALLINT) AS mes, monthname(d) AS mes_nombre,
    CAST(weekofyear(d) AS SMALLINT) AS semana, CAST(day(d) AS SMALLINT) AS dia,
    CAST(isodow(d) AS SMALLINT) AS dia_semana, dayname(d) AS nombre_dia,
    CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS es_fin_semana
  FROM (SELECT DISTINCT CAST(invoice_date AS DATE) AS d FROM clean)),
cust AS (
  SELECT customer_id,
    first(country ORDER BY invoice_date, invoice, country) AS country,
    CAST(count(DISTINCT CASE WHEN is_cancelled = 0 THEN invoice END) AS INTEGER) AS num_facturas
  FROM clean GROUP BY customer_id),
dim_cliente AS (
  SELECT CAST(row_number() OVER (ORDER BY customer_id) AS INTEGER) AS cliente_id, customer_id, country,
    CASE WHEN num_facturas = 0 THEN 'UNKNOWN' WHEN num_facturas = 1 THEN 'NUEVO'
         WHEN num_facturas <= 5 THEN 'REGULAR' WHEN num_facturas <= 15 THEN 'FRECUENTE'
         ELSE 'VIP' END AS segmento,
    num_facturas
  FROM cust),
modal AS (
  SELECT stock_code, description AS descripcion FROM (
    SELECT stock_code, description,
      row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description) AS rk
    FROM (SELECT stock_code, description, count(*) AS n FROM clean
          WHERE description <> {_q(fixed.NO_DESCRIPTION)} AND stock_code IS NOT NULL
          GROUP BY stock_code, description)) WHERE rk = 1),
med AS (
  SELECT stock_code, quantile_cont(CAST(price AS DECIMAL(28,6)), 0.5) AS precio_mediano FROM clean
  WHERE is_cancelled = 0 AND price IS NOT NULL AND stock_code IS NOT NULL GROUP BY stock_code),
dim_producto AS (
  SELECT CAST(row_number() OVER (ORDER BY c.stock_code ASC NULLS FIRST) AS INTEGER) AS producto_id,
    c.stock_code, coalesce(m.descripcion, {_q(fixed.NO_DESCRIPTION)}) AS descripcion,
    CAST(round(coalesce(med.precio_mediano, 0), 2) AS DECIMAL(10,2)) AS precio_referencia
  FROM (SELECT DISTINCT stock_code FROM clean) c
  LEFT JOIN modal m ON c.stock_code = m.stock_code
  LEFT JOIN med ON c.stock_code = med.stock_code),
regions(country, region) AS (VALUES {_REGIONS}),
dim_geografia AS (
  SELECT CAST(row_number() OVER (ORDER BY g.country ASC NULLS FIRST) AS INTEGER) AS geografia_id,
    g.country, coalesce(r.region, {_q(fixed.DEFAULT_REGION)}) AS region
  FROM (SELECT DISTINCT country FROM clean) g LEFT JOIN regions r ON g.country = r.country),
fact_ventas AS (
  SELECT CAST(row_number() OVER (ORDER BY l.invoice_date NULLS FIRST, l.invoice NULLS FIRST,
           l.stock_code NULLS FIRST, l.description NULLS FIRST, l.quantity NULLS FIRST,
           l.price NULLS FIRST, l.customer_id NULLS FIRST, l.country NULLS FIRST) AS BIGINT) AS ventas_id,
    l.invoice AS invoice_number, f.fecha_id, CAST(hour(l.invoice_date) AS INTEGER) AS hora_venta,
    coalesce(c.cliente_id, 0) AS cliente_id, p.producto_id, g.geografia_id,
    CAST(l.quantity AS INTEGER) AS cantidad, CAST(l.price AS DECIMAL(10,2)) AS precio_unitario,
    CAST(l.total_line AS DECIMAL(10,2)) AS total_linea, l.is_cancelled
  FROM clean l
  JOIN dim_fecha f ON CAST(l.invoice_date AS DATE) = f.fecha_completa
  LEFT JOIN dim_cliente c ON l.customer_id = c.customer_id
  JOIN dim_producto p ON l.stock_code IS NOT DISTINCT FROM p.stock_code
  JOIN dim_geografia g ON l.country IS NOT DISTINCT FROM g.country),
sales AS (
  SELECT f.*, c.customer_id, c.segmento, d.fecha_completa, d.anio, d.trimestre, d.mes,
         d.es_fin_semana, g.country, g.region, p.stock_code, p.descripcion, p.precio_referencia
  FROM fact_ventas f JOIN dim_cliente c USING (cliente_id) JOIN dim_fecha d USING (fecha_id)
  JOIN dim_geografia g USING (geografia_id) JOIN dim_producto p USING (producto_id))
"""

_RAW_COLS = fixed.RAW_COLUMNS
_TS = "strftime(invoice_date, '%Y-%m-%d %H:%M:%S')"
_STAGED_VIEW = (f"invoice, stock_code, description, quantity, {_TS} AS invoice_date, "
                f"price, customer_id, country, is_cancelled")
NONC = "is_cancelled = 0"
KNOWN = f"customer_id <> {_q(fixed.UNKNOWN_CUSTOMER)}"


def _null_profile() -> str:
    parts = [f"SELECT {_q(c)} AS column_name, CAST(count(*) FILTER (WHERE \"{c}\" IS NULL) AS BIGINT) AS nulls, "
             f"count(*) AS n FROM raw" for c in _RAW_COLS]
    return ("SELECT column_name, nulls, " + pct("nulls", "n") + " AS null_pct FROM ("
            + " UNION ALL ".join(parts) + ")")


def _ledger() -> str:
    steps = [(0, "duplicates", "(SELECT count(*) FROM staged) - (SELECT count(*) FROM tagged)")]
    for i, r in enumerate(["special_code", "price", "quantity", "date"]):
        steps.append((i + 1, r, f"(SELECT count(*) FROM tagged WHERE rule = {_q(r)})"))
    steps.append((5, "quarantine", "(SELECT count(*) FROM clean) - (SELECT count(*) FROM fact_ventas)"))
    body = " UNION ALL ".join(f"SELECT {i} AS step_no, {_q(s)} AS step, CAST({e} AS BIGINT) AS rows_removed"
                              for i, s, e in steps)
    return ("SELECT CAST(step_no AS INTEGER) AS step_no, step, rows_removed, "
            "CAST((SELECT count(*) FROM staged) - sum(rows_removed) OVER (ORDER BY step_no "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rows_after FROM (" + body + ")")


def _audit_bounds() -> str:
    lim = fixed.DECIMAL_10_2_LIMIT
    checks = []
    for t, widths in fixed.NVARCHAR_WIDTHS.items():
        for c, w in widths.items():
            checks.append((t, c, f"length({c}) > {w}"))
    checks += [("dim_producto", "precio_referencia", f"abs(precio_referencia) >= {lim}"),
               ("fact_ventas", "precio_unitario", f"abs(precio_unitario) >= {lim}"),
               ("fact_ventas", "total_linea", f"abs(total_linea) >= {lim}"),
               ("dim_fecha", "anio", f"anio < 0 OR anio > {fixed.SMALLINT_MAX}")]
    for c in ["trimestre", "mes", "semana", "dia", "dia_semana"]:
        checks.append(("dim_fecha", c, f"{c} < 0 OR {c} > {fixed.TINYINT_MAX}"))
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, "
        f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM {t}"
        for t, c, cond in checks)


_PK = [("dim_fecha", "fecha_id"), ("dim_cliente", "cliente_id"), ("dim_producto", "producto_id"),
       ("dim_geografia", "geografia_id"), ("fact_ventas", "ventas_id")]
_NN = {
    "dim_fecha": ["fecha_id", "fecha_completa", "anio", "trimestre", "mes", "mes_nombre", "semana",
                  "dia", "dia_semana", "nombre_dia", "es_fin_semana"],
    "dim_cliente": ["cliente_id", "customer_id", "country", "segmento", "num_facturas"],
    "dim_producto": ["producto_id", "stock_code", "descripcion", "precio_referencia"],
    "dim_geografia": ["geografia_id", "country", "region"],
    "fact_ventas": ["ventas_id", "invoice_number", "fecha_id", "hora_venta", "cliente_id",
                    "producto_id", "geografia_id", "cantidad", "precio_unitario", "total_linea",
                    "is_cancelled"],
}
_FK = [("fecha_id", "dim_fecha"), ("cliente_id", "dim_cliente"), ("producto_id", "dim_producto"),
       ("geografia_id", "dim_geografia")]

def _typed_as_read(c: str) -> str:
    """Raw column as the source's reader types it: numeric if every value parses."""
    if c not in ("Quantity", "Price"):
        return f'"{c}"'
    all_num = (f'(SELECT count(*) FILTER (WHERE "{c}" IS NOT NULL AND TRY_CAST("{c}" AS DOUBLE) IS NULL) '
               f'= 0 FROM raw)')
    return f'CASE WHEN {all_num} THEN CAST(TRY_CAST("{c}" AS DOUBLE) AS VARCHAR) ELSE "{c}" END'


_RFM_CASE = "CASE " + " ".join(f"WHEN s >= {t} THEN {_q(n)}" for t, n in fixed.RFM_LABELS) + \
    f" ELSE {_q(fixed.RFM_LABEL_REST)} END"

_MATCH = """, m_lines AS MATERIALIZED (
  SELECT *, sum(CASE WHEN is_cancelled = 0 THEN units ELSE 0 END) OVER w AS sold,
         sum(CASE WHEN is_cancelled = 1 THEN units ELSE 0 END) OVER w AS cancelled FROM (
    SELECT ventas_id, producto_id, cliente_id, fecha_id, fecha_completa, hora_venta, is_cancelled, stock_code, precio_unitario,
           greatest(CASE WHEN is_cancelled = 1 THEN -cantidad ELSE cantidad END, 0)::BIGINT AS units FROM sales)
  WINDOW w AS (PARTITION BY cliente_id, producto_id ORDER BY fecha_id, hora_venta, is_cancelled, ventas_id
               ROWS UNBOUNDED PRECEDING)),
m_taken AS MATERIALIZED (
  SELECT *, cancelled + least(0, min(sold - cancelled) OVER (PARTITION BY cliente_id, producto_id
    ORDER BY fecha_id, hora_venta, ventas_id ROWS UNBOUNDED PRECEDING)) AS upto FROM m_lines WHERE is_cancelled = 1),
m_from AS MATERIALIZED (
  SELECT *, coalesce(lag(upto) OVER (PARTITION BY cliente_id, producto_id
    ORDER BY fecha_id, hora_venta, ventas_id), 0) AS since FROM m_taken),
pairs AS MATERIALIZED (
  SELECT c.ventas_id AS cancel_line, s.ventas_id AS sale_line,
         (least(c.upto, s.sold) - greatest(c.since, s.sold - s.units))::BIGINT AS units,
         s.precio_unitario AS price, date_diff('day', s.fecha_completa, c.fecha_completa) AS days, s.producto_id
  FROM m_from c JOIN m_lines s ON s.is_cancelled = 0 AND c.cliente_id = s.cliente_id AND c.producto_id = s.producto_id
    AND c.since < s.sold AND s.sold - s.units < c.upto AND c.upto > c.since AND s.units > 0)
"""


_HISTORY = """, day_country AS (
  SELECT customer_id, fecha_completa, first(country ORDER BY hora_venta, ventas_id) AS country FROM sales GROUP BY ALL),
spans AS MATERIALIZED (
  SELECT *, row_number() OVER w AS version, fecha_completa AS valid_from, lead(fecha_completa) OVER w AS valid_to FROM (
    SELECT *, lag(country) OVER (PARTITION BY customer_id ORDER BY fecha_completa) AS before FROM day_country)
  WHERE country IS DISTINCT FROM before WINDOW w AS (PARTITION BY customer_id ORDER BY fecha_completa))
"""


def _access() -> str:
    def middle(dim: str, key: str) -> str:
        return f"(SELECT max({key}) // 2 + 1 FROM {dim})"
    body = []
    for dim, key, few in (("dim_fecha", "fecha_id", "NULL"), ("dim_cliente", "cliente_id", "true"),
                          ("dim_producto", "producto_id", "true"), ("dim_geografia", "geografia_id", "true")):
        body.append(f"SELECT {_q(key)} AS path, CAST({middle(dim, key)} AS VARCHAR) AS wanted, count(*) AS rows, "
                    f"CAST({few} AS BOOLEAN) AS under_a_fifth FROM fact_ventas WHERE {key} = {middle(dim, key)}")
    body.append("SELECT 'is_cancelled', '1', count(*), NULL FROM fact_ventas WHERE is_cancelled = 1")
    body.append("SELECT 'segmento', 'VIP', count(*), NULL FROM dim_cliente WHERE segmento = 'VIP'")
    body.append(f"SELECT 'anio,mes', any_value(m.anio || ',' || m.mes), count(*), NULL FROM dim_fecha d JOIN (SELECT anio, mes "
                f"FROM dim_fecha WHERE fecha_id = {middle('dim_fecha', 'fecha_id')}) m ON d.anio = m.anio AND d.mes = m.mes")
    body.append(f"SELECT 'region', any_value(m.region), count(*), NULL FROM dim_geografia g JOIN (SELECT region FROM "
                f"dim_geografia WHERE geografia_id = {middle('dim_geografia', 'geografia_id')}) m ON g.region = m.region")
    return " UNION ALL ".join(body)


BODIES: dict[str, str] = {
    # --- sources and profile -------------------------------------------------
    "csv_scan": "SELECT * FROM raw",
    "null_profile": _null_profile(),
    "dup_count": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
                 "(SELECT count(*) AS n FROM raw GROUP BY " + ", ".join(
                     _typed_as_read(c) for c in _RAW_COLS) + ")",
    "cancel_count": "SELECT CAST(count(*) FILTER (WHERE starts_with(\"Invoice\", 'C')) AS BIGINT) "
                    "AS cancelled_lines FROM raw",
    "neg_qty_count": "SELECT CAST(count(*) FILTER (WHERE TRY_CAST(\"Quantity\" AS DOUBLE) < 0) AS BIGINT) "
                     "AS negative_quantities FROM raw",
    "zero_price_count": "SELECT CAST(count(*) FILTER (WHERE TRY_CAST(\"Price\" AS DOUBLE) = 0) AS BIGINT) "
                        "AS zero_prices FROM raw",
    "irregular_codes": "SELECT DISTINCT \"StockCode\", \"Description\" FROM raw "
                       "WHERE NOT coalesce(regexp_matches(\"StockCode\", '^\\d{5}'), false) "
                       "AND NOT coalesce(starts_with(\"StockCode\", 'DCGS'), false) "
                       "AND NOT coalesce(starts_with(\"StockCode\", 'gift'), false)",
    "country_counts": "SELECT \"Country\", count(*) AS lines FROM raw WHERE \"Country\" IS NOT NULL "
                      "GROUP BY \"Country\"",
    "multi_country_customers": "SELECT \"Customer ID\" AS customer_id, "
                               "CAST(count(DISTINCT \"Country\") AS BIGINT) AS countries FROM raw "
                               "WHERE \"Customer ID\" IS NOT NULL GROUP BY \"Customer ID\" "
                               "HAVING count(DISTINCT \"Country\") > 1",
    # --- standardise and clean -------------------------------------------------
    "staged_lines": f"SELECT {_STAGED_VIEW} FROM staged",
    "clean_lines": f"SELECT {_STAGED_VIEW}, CAST(total_line AS DOUBLE) AS total_line FROM clean",
    "cleaning_ledger": _ledger(),
    # --- dimensions --------------------------------------------------------------
    "dim_fecha": "SELECT fecha_id, strftime(fecha_completa, '%Y-%m-%d') AS fecha_completa, anio, "
                 "trimestre, mes, mes_nombre, semana, dia, dia_semana, nombre_dia, es_fin_semana "
                 "FROM dim_fecha",
    "dim_cliente": "SELECT * FROM dim_cliente",
    "dim_cliente_documented": (
        "SELECT cliente_id, customer_id, country, "
        f"CASE WHEN customer_id = {_q(fixed.UNKNOWN_CUSTOMER)} THEN 'UNKNOWN' "
        "WHEN num_facturas <= 1 THEN 'NUEVO' WHEN num_facturas <= 5 THEN 'REGULAR' "
        "WHEN num_facturas <= 15 THEN 'FRECUENTE' ELSE 'VIP' END AS segmento, num_facturas "
        "FROM dim_cliente"),
    "modal_description": "SELECT stock_code, descripcion FROM modal",
    "median_price": "SELECT stock_code, CAST(precio_mediano AS DOUBLE) AS precio_mediano FROM med",
    "dim_producto": "SELECT producto_id, stock_code, descripcion, "
                    "CAST(precio_referencia AS DOUBLE) AS precio_referencia FROM dim_producto",
    "dim_geografia": "SELECT * FROM dim_geografia",
    "dim_distribution": "SELECT 'segmento' AS attribute, segmento AS value, count(*) AS members "
                        "FROM dim_cliente GROUP BY segmento UNION ALL "
                        "SELECT 'region', region, count(*) FROM dim_geografia GROUP BY region",
    # --- fact and load -------------------------------------------------------------
    "fact_ventas": "SELECT ventas_id, invoice_number, fecha_id, hora_venta, cliente_id, producto_id, "
                   "geografia_id, cantidad, CAST(precio_unitario AS DOUBLE) AS precio_unitario, "
                   "CAST(total_linea AS DOUBLE) AS total_linea, is_cancelled FROM fact_ventas",
    "net_revenue": f"SELECT CAST(sum(CASE WHEN {NONC} THEN total_linea END) AS DOUBLE) AS revenue "
                   "FROM fact_ventas",
    "layout": "SELECT CAST(year(fecha_completa) AS INTEGER) AS anio, count(*) AS lines "
              "FROM fact_ventas JOIN dim_fecha USING (fecha_id) GROUP BY 1",
    "access_paths": _access(),
    "refresh_years": (
        "SELECT CAST(anio AS INTEGER) AS anio, count(*) AS lines, "
        f"CAST(sum(CASE WHEN {NONC} THEN total_linea END) AS DOUBLE) AS revenue, "
        "anio = min(anio) OVER () OR anio = max(anio) OVER () AS rewritten FROM sales GROUP BY anio"),
    "refresh_members": (
        "SELECT 'cliente' AS dimension, customer_id AS member, concat_ws('|', country, segmento, num_facturas) AS attributes "
        "FROM dim_cliente UNION ALL SELECT 'producto', stock_code, concat_ws('|', descripcion, precio_referencia) "
        "FROM dim_producto UNION ALL SELECT 'geografia', country, region FROM dim_geografia"),
    "refresh_fact": (
        "SELECT invoice_number, strftime(fecha_completa, '%Y-%m-%d') AS fecha, hora_venta, customer_id, stock_code, country, "
        "cantidad, CAST(precio_unitario AS DOUBLE) AS precio_unitario, CAST(total_linea AS DOUBLE) AS total_linea, "
        "is_cancelled FROM sales"),
    "warehouse_summary": " UNION ALL ".join(
        f"SELECT {_q(t)} AS metric, CAST(count(*) AS DOUBLE) AS value FROM {t}"
        for t in ["dim_fecha", "dim_cliente", "dim_producto", "dim_geografia", "fact_ventas"])
        + f" UNION ALL SELECT 'revenue', CAST(sum(CASE WHEN {NONC} THEN total_linea END) AS DOUBLE) "
          "FROM fact_ventas",
    # --- audits --------------------------------------------------------------------
    "audit_pk": " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, {_q(k)} AS key_column, CAST(count(*) AS BIGINT) AS violations "
        f"FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in _PK),
    "audit_notnull": " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, CAST(count(*) FILTER (WHERE "
        + " OR ".join(f"{c} IS NULL" for c in cols) + f") AS BIGINT) AS violations FROM {t}"
        for t, cols in _NN.items()),
    "audit_fk": " UNION ALL ".join(
        f"SELECT 'fact_ventas.{k}' AS reference, CAST(count(*) AS BIGINT) AS violations "
        f"FROM fact_ventas f WHERE NOT EXISTS (SELECT 1 FROM {d} x WHERE x.{k} = f.{k})"
        for k, d in _FK),
    "audit_bounds": _audit_bounds(),
    # --- Q01-Q20 ---------------------------------------------------------------------
    "q01_kpis": (
        "SELECT CAST(rev AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders, "
        + r2(ratio("rev", "orders")) + " AS avg_ticket, " + pct("canc", "lines") + " AS cancel_rate_pct, "
        "CAST(customers AS BIGINT) AS customers, CAST(products AS BIGINT) AS products, "
        "CAST(countries AS BIGINT) AS countries FROM ("
        f"SELECT sum(CASE WHEN {NONC} THEN total_linea END) AS rev, "
        f"count(DISTINCT CASE WHEN {NONC} THEN invoice_number END) AS orders, "
        "sum(is_cancelled) AS canc, count(*) AS lines, "
        f"count(DISTINCT CASE WHEN {KNOWN} THEN cliente_id END) AS customers, "
        "count(DISTINCT producto_id) AS products, count(DISTINCT geografia_id) AS countries FROM sales)"),
    "q01_sketch_ranges": (
        "SELECT CAST(anio AS INTEGER) AS anio, count(*) AS lines, "
        f"count(DISTINCT CASE WHEN {NONC} AND {KNOWN} THEN cliente_id END) AS customers, true AS customers_ok, "
        f"count(DISTINCT CASE WHEN {NONC} THEN invoice_number END) AS orders, true AS orders_ok, true AS median_ok "
        "FROM sales GROUP BY anio"),
    "removed_duplicates": (
        "SELECT 'a' AS side, count(*) - 1 AS copies, * FROM (SELECT " + _STAGED_VIEW + " FROM staged) GROUP BY ALL "
        "HAVING count(*) > 1"),
    "q08_sessions": (
        "SELECT k AS orders, count(*) AS sessions, " + r2(ratio("sum(last_at - first_at)", "count(*) * 24")) + " AS avg_days "
        "FROM (SELECT customer_id, s, count(*) AS k, min(hr) AS first_at, max(hr) AS last_at FROM ("
        "SELECT *, sum(CASE WHEN hr - before <= " + str(24 * fixed.SESSION_GAP_DAYS) + " THEN 0 ELSE 1 END) OVER ("
        "PARTITION BY customer_id ORDER BY hr, invoice_number) AS s FROM ("
        "SELECT *, lag(hr) OVER (PARTITION BY customer_id ORDER BY hr, invoice_number) AS before FROM ("
        "SELECT customer_id, invoice_number, min(date_diff('day', DATE '1970-01-01', fecha_completa) * 24 + hora_venta) AS hr "
        f"FROM sales WHERE {NONC} AND {KNOWN} GROUP BY ALL))) GROUP BY ALL) GROUP BY k"),
    "q02_yoy": (
        "SELECT CAST(anio AS INTEGER) AS anio, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(prev AS DOUBLE) AS prev_revenue, " + pct("rev - prev", "prev") + " AS growth_pct FROM ("
        "SELECT anio, rev, lag(rev) OVER (ORDER BY anio) AS prev FROM ("
        f"SELECT anio, sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales GROUP BY anio))"),
    "q03_running_month": (
        "SELECT CAST(anio AS INTEGER) AS anio, CAST(mes AS INTEGER) AS mes, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(sum(rev) OVER (ORDER BY anio, mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) "
        "AS running_revenue FROM ("
        f"SELECT anio, mes, sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales GROUP BY anio, mes)"),
    "q04_weekend": (
        "SELECT CAST(es_fin_semana AS INTEGER) AS es_fin_semana, CAST(orders AS BIGINT) AS orders, "
        "CAST(rev AS DOUBLE) AS revenue, " + r2(ratio("rev", "orders")) + " AS revenue_per_order FROM ("
        f"SELECT es_fin_semana, count(DISTINCT CASE WHEN {NONC} THEN invoice_number END) AS orders, "
        f"sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales GROUP BY es_fin_semana)"),
    "q05_month_rank": (
        "SELECT CAST(mes AS INTEGER) AS mes, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(rank() OVER (ORDER BY rev DESC NULLS LAST) AS BIGINT) AS revenue_rank FROM ("
        f"SELECT mes, sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales GROUP BY mes)"),
    "q05_month_rank_by_year": (
        "SELECT CAST(anio AS INTEGER) AS anio, CAST(mes AS INTEGER) AS mes, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(rank() OVER (PARTITION BY anio ORDER BY rev DESC NULLS LAST) AS BIGINT) AS revenue_rank FROM ("
        f"SELECT anio, mes, sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales GROUP BY anio, mes)"),
    "q06_ticket_quarter": (
        "SELECT CAST(anio AS INTEGER) AS anio, CAST(trimestre AS INTEGER) AS trimestre, "
        "CAST(count(*) AS BIGINT) AS orders, " + r2(ratio("sum(ticket)", "count(*)")) + " AS avg_ticket FROM ("
        f"SELECT anio, trimestre, invoice_number, sum(total_linea) AS ticket FROM sales WHERE {NONC} "
        "GROUP BY anio, trimestre, invoice_number) GROUP BY anio, trimestre"),
    "q07_cancel_impact": (
        "SELECT CAST(lines AS BIGINT) AS cancelled_lines, CAST(invoices AS BIGINT) AS cancelled_invoices, "
        "CAST(val AS DOUBLE) AS cancelled_value, CAST(rev AS DOUBLE) AS revenue, "
        + pct("val", "rev") + " AS pct_of_revenue FROM ("
        "SELECT count(*) FILTER (WHERE is_cancelled = 1) AS lines, "
        "count(DISTINCT CASE WHEN is_cancelled = 1 THEN invoice_number END) AS invoices, "
        "-sum(CASE WHEN is_cancelled = 1 THEN total_linea END) AS val, "
        f"sum(CASE WHEN {NONC} THEN total_linea END) AS rev FROM sales)"),
    "q07_cancel_matches": _MATCH + "SELECT cancel_line, sale_line, units FROM pairs",
    "q07_cancel_lines": _MATCH + (
        "SELECT ventas_id, is_cancelled, units, matched_units, CASE WHEN matched_units = 0 THEN 'unmatched' "
        "WHEN matched_units = units THEN 'matched' ELSE 'partial' END AS status FROM ("
        "SELECT l.ventas_id, l.is_cancelled, l.units, CAST(coalesce(CASE WHEN l.is_cancelled = 1 THEN c.n ELSE s.n END, 0) "
        "AS BIGINT) AS matched_units FROM m_lines l "
        "LEFT JOIN (SELECT cancel_line, sum(units) AS n FROM pairs GROUP BY 1) c ON c.cancel_line = l.ventas_id "
        "LEFT JOIN (SELECT sale_line, sum(units) AS n FROM pairs GROUP BY 1) s ON s.sale_line = l.ventas_id)"),
    "q14_matched_returns": _MATCH + (
        "SELECT stock_code, CAST(returned AS BIGINT) AS returned_units, CAST(coalesce(n, 0) AS BIGINT) AS matched_units, "
        + pct("coalesce(n, 0)", "returned") + " AS matched_pct, CAST(worth AS DOUBLE) AS matched_value, "
        + r2(ratio("days", "n")) + " AS avg_days_to_return FROM ("
        "SELECT producto_id, stock_code, sum(units) AS returned FROM m_lines WHERE is_cancelled = 1 GROUP BY ALL "
        "HAVING sum(units) > 0) LEFT JOIN (SELECT producto_id, sum(units) AS n, sum(units * price) AS worth, "
        "sum(units * days) AS days FROM pairs GROUP BY 1) USING (producto_id)"),
    "q08_hours": (
        "SELECT CAST(hora_venta AS INTEGER) AS hora_venta, CAST(orders AS BIGINT) AS orders, "
        + pct("orders", "sum(orders) OVER ()") + " AS share_pct FROM ("
        f"SELECT hora_venta, count(DISTINCT CASE WHEN {NONC} THEN invoice_number END) AS orders "
        "FROM sales GROUP BY hora_venta)"),
    "q09_segment_share": (
        "SELECT segmento, CAST(customers AS BIGINT) AS customers, CAST(rev AS DOUBLE) AS revenue, "
        + pct("rev", "sum(rev) OVER ()") + " AS share_pct FROM ("
        "SELECT c.segmento, count(*) AS customers, sum(coalesce(r.rev, 0)) AS rev FROM dim_cliente c "
        f"LEFT JOIN (SELECT cliente_id, sum(total_linea) AS rev FROM sales WHERE {NONC} GROUP BY cliente_id) r "
        "ON c.cliente_id = r.cliente_id GROUP BY c.segmento)"),
    "q10_top_customers": (
        "SELECT CAST(rk AS BIGINT) AS rank, customer_id, country, segmento, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(orders AS BIGINT) AS orders FROM ("
        "SELECT c.customer_id, c.country, c.segmento, r.rev, r.orders, "
        "row_number() OVER (ORDER BY r.rev DESC, c.customer_id) AS rk FROM dim_cliente c JOIN ("
        "SELECT cliente_id, sum(total_linea) AS rev, count(DISTINCT invoice_number) AS orders FROM sales "
        f"WHERE {NONC} AND {KNOWN} GROUP BY cliente_id) r ON c.cliente_id = r.cliente_id) WHERE rk <= 10"),
    "q11_new_customers": (
        "SELECT CAST(anio AS INTEGER) AS anio, CAST(mes AS INTEGER) AS mes, CAST(n AS BIGINT) AS new_customers, "
        "CAST(sum(n) OVER (ORDER BY anio, mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) "
        "AS cumulative_customers FROM ("
        "SELECT year(first_date) AS anio, month(first_date) AS mes, count(*) AS n FROM ("
        f"SELECT customer_id, min(fecha_completa) AS first_date FROM sales WHERE {NONC} AND {KNOWN} "
        "GROUP BY customer_id) GROUP BY 1, 2)"),
    "q11_cohorts": (
        "SELECT CAST(year(f) AS INTEGER) AS anio, CAST(month(f) AS INTEGER) AS mes, CAST(k AS INTEGER) AS months_later, "
        "CAST(n AS BIGINT) AS customers, " + pct("n", "max(n) FILTER (WHERE k = 0) OVER (PARTITION BY f)") + " AS retention_pct "
        "FROM (SELECT f, date_diff('month', f, m) AS k, count(*) AS n FROM ("
        "SELECT DISTINCT customer_id, date_trunc('month', fecha_completa) AS m, "
        "min(date_trunc('month', fecha_completa)) OVER (PARTITION BY customer_id) AS f FROM sales "
        f"WHERE {NONC} AND {KNOWN}) GROUP BY ALL)"),
    "q12_active_months": (
        "SELECT CAST(k AS INTEGER) AS active_months, count(*) AS customers FROM ("
        "SELECT customer_id, count(DISTINCT date_trunc('month', fecha_completa)) AS k FROM sales "
        f"WHERE {NONC} AND {KNOWN} GROUP BY 1) GROUP BY k"),
    "q12_rolling_active": (
        "SELECT strftime(d.fecha_completa, '%Y-%m-%d') AS fecha, count(DISTINCT o.customer_id) AS active_customers "
        "FROM dim_fecha d LEFT JOIN (SELECT DISTINCT customer_id, fecha_completa FROM sales "
        f"WHERE {NONC} AND {KNOWN}) o ON o.fecha_completa BETWEEN d.fecha_completa - {fixed.ACTIVE_DAYS - 1} "
        "AND d.fecha_completa GROUP BY d.fecha_completa"),
    "customer_history": _HISTORY + (
        "SELECT customer_id, CAST(version AS INTEGER) AS version, country, strftime(valid_from, '%Y-%m-%d') AS valid_from, "
        "strftime(valid_to, '%Y-%m-%d') AS valid_to FROM spans"),
    "sales_by_valid_country": _HISTORY + (
        "SELECT v.country, count(*) AS lines, CAST(sum(CASE WHEN is_cancelled = 0 THEN total_linea END) AS DOUBLE) AS revenue, "
        "CAST(count(*) FILTER (WHERE s.country <> v.country) AS BIGINT) AS lines_elsewhere FROM sales s JOIN spans v "
        "ON s.customer_id = v.customer_id AND s.fecha_completa >= v.valid_from "
        "AND (v.valid_to IS NULL OR s.fecha_completa < v.valid_to) GROUP BY v.country"),
    "q17_subtotals": (
        "SELECT CAST(grouping(region, country, anio) AS INTEGER) AS level, region, country, CAST(anio AS INTEGER) AS anio, "
        f"CAST(sum(CASE WHEN {NONC} THEN total_linea END) AS DOUBLE) AS revenue, count(*) AS lines FROM sales "
        "GROUP BY GROUPING SETS ((region, country, anio), (region, country), (region, anio), (region), (anio), ())"),
    "q12_recurrent": (
        "SELECT CAST(buyers AS BIGINT) AS customers_with_orders, CAST(rec AS BIGINT) AS recurrent_customers, "
        + pct("rec", "buyers") + " AS recurrent_pct FROM ("
        "SELECT count(*) AS buyers, count(*) FILTER (WHERE orders >= 2) AS rec FROM ("
        f"SELECT customer_id, count(DISTINCT invoice_number) AS orders FROM sales WHERE {NONC} AND {KNOWN} "
        "GROUP BY customer_id))"),
    "q13_top_products": (
        "SELECT stock_code, descripcion, CAST(rev AS DOUBLE) AS revenue, CAST(units AS BIGINT) AS units, "
        "CAST(rr AS BIGINT) AS revenue_rank, CAST(ur AS BIGINT) AS units_rank FROM ("
        "SELECT stock_code, descripcion, rev, units, rank() OVER (ORDER BY rev DESC) AS rr, "
        "rank() OVER (ORDER BY units DESC NULLS LAST) AS ur FROM ("
        "SELECT stock_code, descripcion, sum(total_linea) AS rev, sum(cantidad) AS units FROM sales "
        f"WHERE {NONC} GROUP BY producto_id, stock_code, descripcion)) WHERE rr <= 10"),
    "q14_return_rate": (
        "SELECT stock_code, CAST(sold AS BIGINT) AS sold_units, CAST(ret AS BIGINT) AS returned_units, "
        + pct("ret", "sold") + " AS return_rate_pct FROM ("
        f"SELECT producto_id, stock_code, sum(CASE WHEN {NONC} THEN cantidad END) AS sold, "
        "-sum(CASE WHEN is_cancelled = 1 THEN cantidad END) AS ret FROM sales "
        "GROUP BY producto_id, stock_code) WHERE ret > 0"),
    "q15_pareto": (
        "SELECT CAST(rk AS BIGINT) AS rank, stock_code, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(cum AS DOUBLE) AS cumulative_revenue, " + pct("cum", "tot") + " AS cumulative_pct FROM ("
        "SELECT stock_code, rev, row_number() OVER (ORDER BY rev DESC, stock_code ASC NULLS FIRST) AS rk, "
        "sum(rev) OVER (ORDER BY rev DESC, stock_code ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS cum, sum(rev) OVER () AS tot FROM ("
        f"SELECT producto_id, stock_code, sum(total_linea) AS rev FROM sales WHERE {NONC} "
        "GROUP BY producto_id, stock_code)) WHERE (cum - rev) * 5 < tot * 4"),
    "q16_price_vs_ref": (
        "SELECT stock_code, " + r2(ratio("s", "n")) + " AS avg_price, "
        "CAST(precio_referencia AS DOUBLE) AS reference_price, "
        + pct("s - precio_referencia * n", "precio_referencia * n") + " AS gap_pct FROM ("
        "SELECT producto_id, stock_code, precio_referencia, sum(precio_unitario) AS s, count(*) AS n "
        f"FROM sales WHERE {NONC} GROUP BY producto_id, stock_code, precio_referencia)"),
    "q16_price_asof": (
        "SELECT stock_code, CAST(count(*) AS BIGINT) AS lines, CAST(count(p) AS BIGINT) AS priced_lines, "
        "CAST(count(*) FILTER (WHERE precio_unitario > p) AS BIGINT) AS above_lines, "
        "CAST(count(*) FILTER (WHERE precio_unitario < p) AS BIGINT) AS below_lines, "
        + r2(ratio("sum(precio_unitario) FILTER (WHERE p IS NOT NULL)", "count(p)")) + " AS avg_price, "
        + r2(ratio("sum(p)", "count(p)")) + " AS avg_asof_price, "
        + pct("sum(precio_unitario) FILTER (WHERE p IS NOT NULL) - sum(p)", "sum(p)") + " AS gap_pct FROM ("
        f"SELECT s.stock_code, s.producto_id, s.precio_unitario, l.p FROM (SELECT * FROM sales WHERE {NONC}) s "
        "ASOF LEFT JOIN (SELECT producto_id, fecha_id, max(precio_unitario) AS p FROM sales "
        f"WHERE {NONC} GROUP BY ALL) l ON s.producto_id = l.producto_id AND s.fecha_id > l.fecha_id) "
        "GROUP BY producto_id, stock_code"),
    "q17_geo_share": (
        "SELECT country, region, CAST(rev AS DOUBLE) AS revenue, "
        + pct("rev", "sum(rev) OVER ()") + " AS share_total_pct, "
        + pct("rev", "sum(rev) OVER (PARTITION BY region)") + " AS share_region_pct FROM ("
        f"SELECT country, region, sum(total_linea) AS rev FROM sales WHERE {NONC} "
        "GROUP BY geografia_id, country, region)"),
    "q18_top3_country": (
        "SELECT country, CAST(rk AS BIGINT) AS rank, stock_code, CAST(rev AS DOUBLE) AS revenue FROM ("
        "SELECT country, stock_code, rev, row_number() OVER (PARTITION BY country "
        "ORDER BY rev DESC, stock_code ASC NULLS FIRST) AS rk FROM ("
        f"SELECT country, stock_code, sum(total_linea) AS rev FROM sales WHERE {NONC} "
        "GROUP BY geografia_id, country, producto_id, stock_code)) WHERE rk <= 3"),
    "q19_region_yoy": (
        "SELECT region, CAST(anio AS INTEGER) AS anio, CAST(rev AS DOUBLE) AS revenue, "
        "CAST(prev AS DOUBLE) AS prev_revenue, " + pct("rev - prev", "prev") + " AS growth_pct FROM ("
        "SELECT region, anio, rev, lag(rev) OVER (PARTITION BY region ORDER BY anio) AS prev FROM ("
        f"SELECT region, anio, sum(total_linea) AS rev FROM sales WHERE {NONC} GROUP BY region, anio))"),
    "q20_rfm": (
        "SELECT customer_id, recency_days, CAST(frequency AS BIGINT) AS frequency, "
        "CAST(monetary AS DOUBLE) AS monetary, CAST(r AS BIGINT) AS r_score, CAST(f AS BIGINT) AS f_score, "
        "CAST(m AS BIGINT) AS m_score, CAST(s AS BIGINT) AS rfm_score, " + _RFM_CASE + " AS rfm_segment FROM ("
        "SELECT *, r + f + m AS s FROM ("
        "SELECT customer_id, recency_days, frequency, monetary, "
        "ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r, "
        "ntile(5) OVER (ORDER BY frequency, customer_id) AS f, "
        "ntile(5) OVER (ORDER BY monetary, customer_id) AS m FROM ("
        "SELECT customer_id, CAST(date_diff('day', last_date, (SELECT max(fecha_completa) FROM sales "
        f"WHERE {NONC} AND {KNOWN})) + 1 AS BIGINT) AS recency_days, frequency, monetary FROM ("
        "SELECT customer_id, max(fecha_completa) AS last_date, count(DISTINCT invoice_number) AS frequency, "
        f"sum(total_linea) AS monetary FROM sales WHERE {NONC} AND {KNOWN} GROUP BY customer_id))))"),
    # --- dashboard metrics ---------------------------------------------------------------
    "k1_vip_concentration": (
        "SELECT CAST(n AS BIGINT) AS vip_customers, CAST(vip AS DOUBLE) AS vip_revenue, "
        + pct("vip", "rev") + " AS vip_share_pct, " + r2(ratio("vip", "n")) + " AS revenue_per_vip FROM ("
        "SELECT count(*) FILTER (WHERE c.segmento = 'VIP') AS n, "
        "sum(CASE WHEN c.segmento = 'VIP' THEN r.rev END) AS vip, sum(r.rev) AS rev FROM dim_cliente c "
        f"LEFT JOIN (SELECT cliente_id, sum(total_linea) AS rev FROM sales WHERE {NONC} GROUP BY cliente_id) r "
        "ON c.cliente_id = r.cliente_id)"),
    "k2_market_gap": (
        "SELECT max(CASE WHEN pos = 1 THEN country END) AS top_country, "
        "CAST(max(CASE WHEN pos = 1 THEN rev END) AS DOUBLE) AS top_revenue, "
        + pct("max(CASE WHEN pos = 1 THEN rev END)", "max(tot)") + " AS top_share_pct, "
        "max(CASE WHEN pos = 2 THEN country END) AS second_country, "
        "CAST(max(CASE WHEN pos = 2 THEN rev END) AS DOUBLE) AS second_revenue, "
        + r2(ratio("max(CASE WHEN pos = 1 THEN rev END)", "max(CASE WHEN pos = 2 THEN rev END)"))
        + " AS gap_ratio FROM ("
        "SELECT country, rev, row_number() OVER (ORDER BY rev DESC, country ASC NULLS FIRST) AS pos, "
        "sum(rev) OVER () AS tot FROM ("
        f"SELECT country, sum(total_linea) AS rev FROM sales WHERE {NONC} GROUP BY geografia_id, country))"
        " WHERE pos <= 2"),
    "k3_top5_share": (
        "SELECT CAST(sum(rev) FILTER (WHERE pos <= 5) AS DOUBLE) AS top5_revenue, "
        "CAST(sum(rev) AS DOUBLE) AS total_revenue, "
        + pct("sum(rev) FILTER (WHERE pos <= 5)", "sum(rev)") + " AS top5_share_pct FROM ("
        "SELECT rev, row_number() OVER (ORDER BY rev DESC, stock_code ASC NULLS FIRST) AS pos FROM ("
        f"SELECT stock_code, sum(total_linea) AS rev FROM sales WHERE {NONC} GROUP BY producto_id, stock_code))"),
    "k4_business_hours": (
        "SELECT CAST(inside AS BIGINT) AS orders_in_hours, CAST(orders AS BIGINT) AS orders, "
        + pct("inside", "orders") + " AS share_pct FROM ("
        f"SELECT count(DISTINCT CASE WHEN {NONC} AND hora_venta >= {fixed.BUSINESS_HOURS[0]} "
        f"AND hora_venta < {fixed.BUSINESS_HOURS[1]} THEN invoice_number END) AS inside, "
        f"count(DISTINCT CASE WHEN {NONC} THEN invoice_number END) AS orders FROM sales)"),
}


def oracle_sql() -> dict[str, str]:
    return {name: PRELUDE + body for name, body in BODIES.items()}
