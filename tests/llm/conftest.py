import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import ODD_TEXTS, SF01  # noqa: E402


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Small tables: two shuffle partitions spare most of the scheduling time."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", "clash", 7, [1], {"k": 1}) for i, t in ODD_TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, name string, n long, blocks array<int>, shard map<string,int>")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c
