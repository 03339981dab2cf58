"""A refresh is all or nothing, and a build belongs to the content of its input."""

import os
import shutil

import pytest

from almacen import session
from almacen.functions import fixed
from almacen.plans import catalog, warehouse
from almacen.sources import sinks
from almacen.sources.feed import SOURCE_TABLES

SF = "/root/testdata/sf0.001"


def test_interrupted_refresh_leaves_the_old_star(spark, star, scratch, monkeypatch):
    base = scratch("refresh")
    first = warehouse.build(spark, SF, base=base, raw=star.landing.limit(500))
    monkeypatch.setattr(sinks, "write_fact", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        warehouse.build(spark, SF, base=base, raw=star.landing.limit(300))
    monkeypatch.undo()
    now = warehouse.load(spark, base)
    assert now.base == first.base and now.rows == first.rows
    second = warehouse.build(spark, SF, base=base, raw=star.landing.limit(300))
    assert warehouse.load(spark, base).base == second.base != first.base
    assert warehouse.retire(spark, base, keep=1) == [os.path.basename(first.base)]
    assert warehouse.load(spark, base).rows == second.rows


def test_a_damaged_build_is_refused(spark, star, scratch):
    base = scratch("damaged")
    s = warehouse.build(spark, SF, base=base, raw=star.landing.limit(200))
    kept = spark.createDataFrame(s["dim_geografia"].collect()[:1], s["dim_geografia"].schema)
    kept.write.mode("overwrite").parquet(f"{s.base}/dim_geografia")
    with pytest.raises(ValueError, match="dim_geografia"):
        warehouse.load(spark, base)
    assert warehouse.load(spark, scratch("nothing")) is None


def test_changed_input_is_built_anew(spark, tmp_path):
    for t in SOURCE_TABLES:
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    before = warehouse.star_dir(spark, str(tmp_path))
    assert before == warehouse.star_dir(spark, str(tmp_path))
    n = warehouse.star(spark, str(tmp_path)).rows["fact_ventas"]
    half = spark.read.parquet(f"{SF}/lineitem.parquet").limit(3000).toPandas()
    half.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    assert warehouse.star_dir(spark, str(tmp_path)) != before
    assert warehouse.star(spark, str(tmp_path)).rows["fact_ventas"] < n


def test_results_do_not_depend_on_the_session_clock(spark, star):
    old = spark.conf.get("spark.sql.session.timeZone")
    names = ["staged_lines", "dim_fecha", "q08_hours", "q03_running_month", "fact_ventas"]
    want = {n: sorted(map(str, catalog.registry()[n](spark, SF).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        london = warehouse.build(spark, SF, base=f"{session.shared_dir(spark)}/london")
        saved = warehouse.pin(spark, SF, london)
        got = {n: sorted(map(str, catalog.registry()[n](spark, SF).collect())) for n in names}
        warehouse.pin(spark, SF, saved)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == want


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, key, default=None):
            return self.kv.get(key, default)

    class Session:
        def __init__(self, **kv):
            self.conf = Conf(**kv)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(**{"spark.master": "yarn"}))
    assert session.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"


def test_fixed_lists():
    assert len(fixed.SPECIAL_CODES) == 17 and {"POST", "m", "BANK CHARGES"} <= set(fixed.SPECIAL_CODES)
    assert len(fixed.REGIONS) == 45 and fixed.REGIONS["Japan"] == "Asia" and fixed.REGIONS["Norway"] == "Europa Nordica"
    assert fixed.CSV_NULL_TOKENS.count("") == 1 and len(fixed.CSV_NULL_TOKENS) == 19
    assert (fixed.SEGMENT_REGULAR_MAX, fixed.SEGMENT_FREQUENT_MAX) == (5, 15)


def test_rounding_is_symmetric(spark):
    from pyspark.sql import functions as F

    from almacen.functions.columns import round2
    df = spark.createDataFrame([(12.345,), (-12.345,), (-0.004,), (0.125,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(round2(F.col("x"))).collect()] == [12.35, -12.35, 0.0, 0.13, -0.13, None]
