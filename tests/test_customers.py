"""Histories, cohorts, rolling activity, sessions, sketches and reconciliation against plain versions."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from almacen.operators import history, reconcile, retention, sessions, sketches
from almacen.plans import queries

DAY0 = dt.date(2020, 1, 1)


def _day(n):
    return DAY0 + dt.timedelta(days=n)


def test_every_line_finds_one_interval(spark):
    rnd = random.Random(3)
    fact = [(rnd.choice([1, 1, 1, 2, 3]), d, rnd.randint(0, 23), i, rnd.choice([5, 5, 6, 7])) for i, d in
            enumerate(rnd.choices(range(0, 400, 3), k=600))]
    fact_df = spark.createDataFrame(fact, "cliente_id int, fecha_id int, hora_venta int, ventas_id long, geografia_id int")
    dates = spark.createDataFrame([(d, _day(d)) for d in range(400)], "fecha_id int, fecha_completa date")
    spans = history.country_intervals(fact_df, dates)
    want = []
    for c in (1, 2, 3):
        first = {}
        for _, d, h, i, g in sorted((r for r in fact if r[0] == c), key=lambda r: (r[1], r[2], r[3])):
            first.setdefault(d, g)
        changes = [(d, g) for k, (d, g) in enumerate(sorted(first.items())) if not k or g != sorted(first.items())[k - 1][1]]
        want += [(c, k + 1, g, _day(d), _day(changes[k + 1][0]) if k + 1 < len(changes) else None) for k, (d, g) in enumerate(changes)]
    assert sorted(map(tuple, spans.collect()), key=str) == sorted(want, key=str)
    lines = fact_df.join(dates, "fecha_id")
    found = history.valid_at(lines, spans, "fecha_completa", dates.agg(F.max("fecha_completa"))).collect()
    assert len(found) == len(fact)
    for r in found:
        held = [g for c, _, g, a, b in want if c == r["cliente_id"] and a <= r["fecha_completa"] and (b is None or r["fecha_completa"] < b)]
        assert held == [r["valid_geografia"]]


@pytest.mark.parametrize("months", [3, 40, 130])
def test_cohorts_of_any_length(spark, months):
    rnd = random.Random(months)
    orders = {(rnd.randrange(30), rnd.randrange(months)) for _ in range(200)}
    bits = retention.month_bitmaps(spark.createDataFrame(sorted(orders) * 2, "customer int, month int"), months)
    by = defaultdict(set)
    for c, m in orders:
        by[c].add(m)
    want = Counter((min(ms), m - min(ms)) for ms in by.values() for m in ms)
    got = {(r["first"], r["later"]): r["customers"] for r in retention.cohorts(bits, months).collect()}
    assert got == dict(want)
    counts = {r["active_months"]: r["customers"] for r in retention.active_months(bits).collect()}
    assert counts == dict(Counter(len(ms) for ms in by.values()))


@pytest.mark.parametrize("days", [1, 7, 30])
def test_rolling_active_customers(spark, days):
    rnd = random.Random(days)
    orders = sorted({(rnd.randrange(15), rnd.randrange(120)) for _ in range(150)})
    df = spark.createDataFrame([(c, _day(d)) for c, d in orders], "customer int, day date")
    calendar = spark.createDataFrame([(_day(d),) for d in range(0, 130, 2)], "day date")
    got = {r["day"]: r["active"] for r in retention.rolling_active(df, calendar, days).collect()}
    assert got == {_day(d): len({c for c, x in orders if d - days < x <= d}) for d in range(0, 130, 2)}


def test_sessions_end_at_gaps(spark):
    rnd = random.Random(9)
    orders = [(rnd.choice([1, 1, 1, 2, 3]), f"i{k}", rnd.randrange(3000)) for k in range(300)] + [(4, "x", None)]
    got = sorted(map(tuple, sessions.sessions(spark.createDataFrame(orders, "customer int, invoice string, at long"), 24).collect()))
    want = []
    for c in (1, 2, 3):
        times, n = sorted(at for cc, _, at in orders if cc == c), 0
        for k, at in enumerate(times):
            if not k or at - times[k - 1] > 24:
                n += 1
                want.append([c, n, 0, at, at])
            want[-1][2] += 1
            want[-1][4] = at
    assert got == sorted(map(tuple, want))


def test_merged_sketches_are_near(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 40).cast("int").alias("fecha_id"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("int").alias("cliente_id"),
        F.concat(F.lit("i"), F.col("id") % 20_000).alias("invoice_number"), (F.col("id") % 1000).cast("decimal(10,2)").alias("precio_unitario"),
        F.lit(0).alias("is_cancelled"))
    days = sketches.daily(df, F.lit(True))
    assert days.count() == 40 and max(len(r["customers"]) for r in days.select("customers").collect()) < 40_000
    r = sketches.merged(days.filter("fecha_id < 40")).first()
    assert r["lines"] == 60_000
    assert abs(r["customers"] - df.select("cliente_id").distinct().count()) < 150 and abs(r["orders"] - 20_000) < 600
    assert 450 < r["median_price"] < 550


def test_difference_of_multisets(spark):
    rnd = random.Random(2)
    a = [(rnd.randrange(50), rnd.choice(["x", None, ""]), rnd.choice([1.5, None])) for _ in range(500)]
    b = a[:]
    rnd.shuffle(b)
    df = lambda rows: spark.createDataFrame(rows, "k int, row string, n double")
    same, seen = reconcile.difference(df(a), df(b).select("n", "row", "k"))
    assert same.count() == 0 and seen == {"coarse": 0, "fine": 0}
    planted = b[3:] + [(7, "new", None), (7, "new", None), (None, "x", 1.5)]
    found, seen = reconcile.difference(df(a), df(planted))
    want = Counter(a) - Counter(planted), Counter(planted) - Counter(a)
    assert Counter({(r["side"], r["k"], r["row"], r["n"]): r["copies"] for r in found.collect()}) == Counter(
        {(s, *row): n for s, c in zip("ab", want) for row, n in c.items()})
    assert 0 < seen["coarse"] <= 6 and 0 < seen["fine"] <= 6
    assert reconcile.difference(df([]), df([]))[0].count() == 0


def test_subtotals_read_the_fact_once(star):
    plan = queries.q17_subtotals(star)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("fact_ventas") + plan.count("total_linea#") >= 1 and plan.count("Expand") == 1
    leaves = queries.q17_subtotals(star)._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert leaves.count("is_cancelled") == 1
