"""One raw line per cleaning trap (FIXTURES.md §3), through CSV -> stage -> clean."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from almacen.functions import fixed
from almacen.operators import clean as clean_ops
from almacen.operators.dims import dim_cliente
from almacen.operators.stage import stage
from almacen.sources.csv import csv_scan

# Invoice, StockCode, Description, Quantity, InvoiceDate, Price, Customer ID, Country
D = ("85048", "WHITE MUG", "6", "2010-12-01 08:26:00", "6.95", "13085.0", "United Kingdom")


def row(inv, code=D[0], desc=D[1], qty=D[2], date=D[3], price=D[4], cust=D[5], country=D[6]):
    return (inv, code, desc, qty, date, price, cust, country)


ROWS = [
    row("500001", desc=" white mug "),                         # E01 kept, normalised
    row("500001", desc=" WHITE MUG ", cust="13085"),           # E02 duplicate after normalising
    row("C500003", qty="-3"),                                  # E03 cancellation kept
    row("C500004", price="0"),                                 # E04 cancelled, price 0 kept
    row("500005", qty="-5"),                                   # E05 removed: quantity
    row("500006", price="0"),                                  # E06 removed: price
    row("500007", price="abc"),                                # E07 kept, NULL price
    row("500008", qty="x"),                                    # E08 kept, NULL quantity
    row("500009", date="not-a-date"),                          # E09 removed: date
    row("500010", code="POST"),                                # E10 removed: special code
    row("500011", code="m"),                                   # E11 removed: special code
    row("500012", code="DCGS0003"),                            # E12 kept
    row("500013", code="post"),                                # E13 kept (case-sensitive)
    row("500014", desc="", cust=""),                           # E14 empty -> defaults
    row("500015", desc="NA", cust="NA"),                       # E15 NA token -> defaults
    row("500016", code=""),                                    # E16 NULL code kept
    row("500017", desc="   ", cust="13087.0 ", country="Atlantis"),  # E17 blank desc, suffix stays
    row("C500018", qty="-1", cust="99999.0"),                  # E18 cancel-only customer
    row("c500018", cust="13090.0"),                            # E19 lower-case c: not cancelled
    row("500024", qty="6.0"),                                  # E24 six
    row("C500025", qty="-6.0"),                                # E25 minus six
    row("500026", price="0.00004"),                            # E26 a price above zero
    row("500027", price="0.12345"),                            # E27 two prices, not one
    row("500027", price="0.12349"),
    row("500028", price="1e15"),                               # E28 a price that no column holds
    row("500020", desc=" TAB\t", qty="1", price="0.125"),  # E20 NBSP/tab strip, HALF_UP total
]

EXPECT_RULE = {
    "500005": "quantity", "500006": "price", "500009": "date",
    "500010": "special_code", "500011": "special_code",
}


@pytest.fixture(scope="module")
def tagged(spark, scratch):
    import csv
    import os
    path = scratch("edge-csv")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(fixed.RAW_COLUMNS)
        w.writerows(ROWS)
    raw = csv_scan(spark, path)
    staged = stage(raw)
    return raw, staged, clean_ops.tag(staged)


def test_raw_and_dedup_counts(tagged):
    raw, staged, t = tagged
    assert raw.count() == len(ROWS)
    assert t.count() == len(ROWS) - 1          # E02 collapses into E01


def test_removal_rules(tagged):
    _, _, t = tagged
    got = {r["invoice"]: r["rule"] for r in t.select("invoice", "rule").collect()}
    for inv, rule in got.items():
        assert rule == EXPECT_RULE.get(inv), inv


def test_normalisation(tagged):
    _, _, t = tagged
    c = {r["invoice"]: r for r in clean_ops.clean_from_tagged(t).collect()}
    assert c["500001"]["description"] == "WHITE MUG" and c["500001"]["customer_id"] == "13085"
    assert c["C500003"]["is_cancelled"] == 1 and c["C500003"]["total_line"] == Decimal("-20.85")
    assert c["C500004"]["is_cancelled"] == 1
    assert c["500007"]["price"] is None and c["500007"]["total_line"] is None
    assert c["500008"]["quantity"] is None
    assert c["500012"]["stock_code"] == "DCGS0003" and c["500013"]["stock_code"] == "post"
    assert c["500014"]["description"] == "SIN DESCRIPCION" and c["500014"]["customer_id"] == "UNKNOWN"
    assert c["500015"]["description"] == "SIN DESCRIPCION" and c["500015"]["customer_id"] == "UNKNOWN"
    assert c["500016"]["stock_code"] is None
    assert c["500017"]["description"] == "" and c["500017"]["customer_id"] == "13087.0"
    assert c["c500018"]["is_cancelled"] == 0
    assert c["500024"]["quantity"] == 6 and c["500024"]["total_line"] == Decimal("41.70")
    assert c["C500025"]["quantity"] == -6 and c["C500025"]["total_line"] == Decimal("-41.70")
    assert c["500026"]["price"] == 0.00004 and c["500026"]["total_line"] == Decimal("0.00")
    assert t.filter("invoice = '500027'").count() == 2
    assert c["500028"]["price"] == 1e15 and c["500028"]["total_line"] is None
    assert c["500020"]["description"] == "TAB" and c["500020"]["total_line"] == Decimal("0.13")


def test_cancel_only_customer_is_unknown_segment(tagged):
    _, _, t = tagged
    d = {r["customer_id"]: r for r in dim_cliente(clean_ops.clean_from_tagged(t)).collect()}
    assert d["99999"]["segmento"] == "UNKNOWN" and d["99999"]["num_facturas"] == 0
    # the anonymous member is graded by its own invoices (code semantics)
    assert d["UNKNOWN"]["num_facturas"] == 2 and d["UNKNOWN"]["segmento"] == "REGULAR"


def test_ledger_sums(tagged):
    raw, staged, t = tagged
    held = clean_ops.clean_from_tagged(t).filter("price is null or quantity is null")
    led = clean_ops.ledger(staged, t, held).orderBy("step_no").collect()
    assert [r["step"] for r in led] == ["duplicates", "special_code", "price", "quantity", "date", "quarantine"]
    assert [r["rows_removed"] for r in led] == [1, 2, 1, 1, 1, 2]
    assert led[-2]["rows_after"] == clean_ops.clean_from_tagged(t).count()
    assert led[-1]["rows_after"] == raw.count() - sum(r["rows_removed"] for r in led)


def test_csv_keeps_whitespace_and_nulls(tagged):
    raw, _, _ = tagged
    r = {x["Invoice"]: x for x in raw.collect()}
    e01 = raw.filter((F.col("Invoice") == "500001") & (F.col("`Customer ID`") == "13085.0")).first()
    assert e01["Description"] == " white mug "
    assert r["500014"]["Description"] is None and r["500015"]["Customer ID"] is None
    assert r["500017"]["Customer ID"] == "13087.0 "
    assert raw.filter(F.col("StockCode").isNull()).count() == 1


def test_build_from_existing_csv(spark, scratch, tagged):
    """The whole build reads raw CSV files in place (no landing copy)."""
    from almacen.plans import warehouse
    raw, _, _ = tagged
    src = raw.inputFiles()[0].rsplit("/", 1)[0]
    s = warehouse.build_from_csv(spark, src, base=scratch("csv-star"))
    assert s.rows["fact_ventas"] + s.rows["quarantine"] == len(ROWS) - 1 - len(EXPECT_RULE)
    assert s.rows["quarantine"] == 4       # E07 NULL price, E08 NULL quantity, E16 NULL code, E28 too large
    again = warehouse.load(spark, s.base.split("/builds/")[0])
    assert again.landing.count() == len(ROWS) and again.rows == s.rows
    led = clean_ops.ledger(s.staged, s.tagged, s.quarantine).orderBy("step_no").collect()
    assert led[-1]["rows_after"] == s.fact.count()        # raw lines less the ledger are the fact


def test_duplicates_compare_inferred_columns_as_read(spark):
    from almacen.operators.profile import duplicate_count
    schema = ", ".join(f"`{c}` string" for c in fixed.RAW_COLUMNS)
    a = row("500001", price="6.95")
    b = row("500001", price="6.950")            # same number, other text
    numeric = spark.createDataFrame([a, b], schema)
    assert duplicate_count(numeric).first()["duplicates"] == 1
    mixed = spark.createDataFrame([a, b, row("500002", price="abc")], schema)
    assert duplicate_count(mixed).first()["duplicates"] == 0   # Price stays text


def _star_of(spark, scratch, rows, name, **options):
    import csv
    import os

    from almacen.plans import warehouse
    path = scratch(name)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(fixed.RAW_COLUMNS)
        w.writerows(rows)
    return warehouse.build_from_csv(spark, path, base=scratch(f"{name}-star"), **options)


def test_null_and_unmapped_keys_in_the_star(spark, scratch):
    """E16 (NULL stock code) and E17 (unmapped country) through the whole build."""
    from almacen.operators import audit
    s = _star_of(spark, scratch, [r for r in ROWS if r[0] not in ("500007", "500008", "500028")], "edge-csv-2")
    geo = {r["country"]: r["region"] for r in s["dim_geografia"].collect()}
    assert geo["Atlantis"] == "Otros" and geo["United Kingdom"] == "Europa Occidental"
    # A member without a code is no member: it and its line are held back and counted.
    assert s["dim_producto"].filter(F.col("stock_code").isNull()).count() == 0
    assert [r["stock_code"] for r in s.rejected["dim_producto"].collect()] == [None]
    assert [r["invoice"] for r in s.quarantine.collect()] == ["500016"]
    held = audit.held_back(s.rejected, s.quarantine)
    nn = {r["table_name"]: r["violations"] for r in audit.audit_notnull(s.tables, held).collect()}
    assert nn["dim_producto"] == 1 and nn["fact_ventas"] == 1 and nn["dim_cliente"] == 0
    assert audit.audit_fk(s.tables).agg(F.sum("violations")).first()[0] == 0
    ids = [r["ventas_id"] for r in s.fact.select("ventas_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_audits_count_violations(spark, scratch):
    from almacen.operators import audit
    long_code, dear = "X" * 25, "999999999.00"
    rows = [row("600001"), row("600002", code=long_code), row("600003", code="DEAR", price=dear),
            row("C" + "6" * 24), row("600005", country="")]
    s = _star_of(spark, scratch, rows, "edge-csv-3")
    held = audit.held_back(s.rejected, s.quarantine)
    bounds = {(r["table_name"], r["column_name"]): r["violations"] for r in audit.audit_bounds(s.tables, held).collect()}
    assert bounds["dim_producto", "stock_code"] == 1 and bounds["dim_producto", "precio_referencia"] == 1
    assert bounds["fact_ventas", "precio_unitario"] == 1 and bounds["fact_ventas", "total_linea"] == 1
    assert bounds["fact_ventas", "invoice_number"] == 1 and sum(bounds.values()) == 5
    nn = {r["table_name"]: r["violations"] for r in audit.audit_notnull(s.tables, held).collect()}
    assert nn["dim_geografia"] == 1 and nn["fact_ventas"] >= 1
    twice = s["dim_cliente"].unionByName(s["dim_cliente"])
    pk = {r["table_name"]: r["violations"] for r in audit.audit_pk(s.tables | {"dim_cliente": twice}).collect()}
    assert pk["dim_cliente"] == s["dim_cliente"].count() and pk["dim_producto"] == 0
    gone = s.tables | {"dim_producto": s["dim_producto"].limit(0)}
    fk = {r["reference"]: r["violations"] for r in audit.audit_fk(gone).collect()}
    assert fk["fact_ventas.producto_id"] == s.fact.count() and fk["fact_ventas.fecha_id"] == 0
    led = clean_ops.ledger(s.staged, s.tagged, s.quarantine).orderBy("step_no").collect()
    assert led[-1]["rows_after"] == s.fact.count()


CSV_ROWS = [                                                    # E21-E25 of the CSV dialect
    row("700001", desc='SET "A" MUG'), row("700002", desc='12" RULER, PINK'), row("700003", desc="two\nlines"),
    row("700004", desc="trailing backslash\\"), row("700005", desc='"'), row("700006", desc=",,"),
]


def test_standard_csv(spark, scratch):
    import os

    from almacen.sources.csv import parsed, read_lines, rejected, write_csv
    s = _star_of(spark, scratch, CSV_ROWS, "edge-dialect", multi_line=True)
    got = {tuple(r) for r in s.landing.collect()}
    assert got == set(CSV_ROWS) and s.rows["rejected_lines"] == 0
    # Line by line, the record with a break in it is rejected, the others are read.
    lines = read_lines(spark, s.landing_path)
    assert {tuple(r) for r in parsed(lines).collect()} == {r for r in CSV_ROWS if "\n" not in r[2]}
    again = scratch("edge-rewritten")
    write_csv(s.landing, again)
    assert {tuple(r) for r in parsed(read_lines(spark, again, multi_line=True)).collect()} == set(CSV_ROWS)
    path = scratch("edge-extra")
    os.makedirs(path)
    with open(os.path.join(path, "p.csv"), "w", encoding="utf-8") as fh:
        fh.write(",".join(fixed.RAW_COLUMNS) + "\n" + ",".join(CSV_ROWS[3]) + "\n" + ",".join(row("1")) + ",extra\n"
                 + "1,2,3\n")
    lines = scratch("edge-extra-lines")
    read_lines(spark, path).write.parquet(lines)
    assert parsed(spark.read.parquet(lines)).count() == 1
    assert {r["line"] for r in rejected(spark.read.parquet(lines)).collect()} == {",".join(row("1")) + ",extra", "1,2,3"}


def test_other_date_layout(spark, scratch):
    rows = [row("800001", date="01/12/2010 08:26"), row("800002", date="28/03/2010 01:30")]
    with pytest.raises(ValueError, match="2 of 2 dates"):
        _star_of(spark, scratch, rows, "edge-dates")
    s = _star_of(spark, scratch, rows, "edge-dates-2", ts_format="dd/MM/yyyy HH:mm")
    assert {str(r["fecha_completa"]) for r in s["dim_fecha"].collect()} == {"2010-12-01", "2010-03-28"}
    assert sorted(r["hora_venta"] for r in s.fact.collect()) == [1, 8]
