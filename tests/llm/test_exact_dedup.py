import brute
import pytest
from samples import SF

from almacen.llm import exact_dedup, queries
from almacen.llm.common import table


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()),
                  key=repr)


@pytest.mark.parametrize("block", [1000, 4096])
def test_odd_rows(odd, block):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert _rows(exact_dedup.exact_dedup(odd, block)) == sorted(brute.exact(docs), key=repr)


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert _rows(queries.op1_exact_dedup(spark, SF)) == sorted(brute.exact(docs), key=repr)


def test_blocks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash of four values nearly all blocks collide; names must still be exact."""
    from pyspark.sql import functions as F
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(4)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["abcabc", "abcabd", "abdabc", "xyz", "XYZ", "abcabc", "qq", "qqq", "", None, "abcabdabc", "abcabcabd"])],
        "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    assert _rows(exact_dedup.exact_dedup(docs, 3)) == sorted(brute.exact(rows), key=repr)
