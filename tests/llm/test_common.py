import random

import pytest
from pyspark.sql import functions as F

from almacen.llm import common


@pytest.mark.parametrize("given, kept", [("64m", str(4 << 20)), ("1mb", "1mb"), ("4096", "4096")])
def test_batches_are_only_made_smaller(spark, given, kept):
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        spark.conf.set(common.BATCH_SETTING, given)
        common.lean(spark.range(1))
        assert spark.conf.get(common.BATCH_SETTING) == kept
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_batches_of_long_texts_are_bounded(spark):
    rows = common.lean(spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text")))
    sizes = rows.mapInArrow(lambda bs: (b.select([]).from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert len(sizes) >= 8 and max(r["n"] for r in sizes) <= 2 * common.BATCH_BYTES


def _chains(lengths):
    """Chains of nodes in shuffled order, and each node's least."""
    rnd, edges, least, start = random.Random(5), [], {}, 0
    for k in lengths:
        nodes = list(range(start, start + k))
        start += k
        rnd.shuffle(nodes)
        edges += zip(nodes, nodes[1:])
        least |= dict.fromkeys(nodes, min(nodes))
    return edges, least


def test_tables_of_a_small_graph_take_few_tasks(spark, monkeypatch):
    files, write = {}, common.staged

    def counted(df, name):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(common, "staged", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges, least = _chains([2, 3, 50, 400])
        got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["comp"] for r in got} == least and len(got) == len(least)
    assert {*files["cc-hook"], *files["cc-jump"], *files["cc-edges"][1:]} == {1}


def test_tables_of_a_larger_graph_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_TASK", 100)
    edges, least = _chains([2, 3, 50, 400])
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["comp"] for r in got} == least and len(got) == len(least)
    assert common.packed(spark.range(0, 1000, 1, 20), 1000).rdd.getNumPartitions() == 10
