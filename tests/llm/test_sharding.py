import zlib
from collections import Counter, defaultdict

from samples import SF01

from almacen.llm import queries, sharding
from almacen.llm.common import table


def _places(df):
    slots = defaultdict(list)
    for r in df.select("shard", "slot").collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(16)]
    assert set(slots) <= set(range(16)) and max(sizes) - min(sizes) <= 1


def test_odd_rows(odd):
    out = sharding.external_shuffle(odd.drop("shard"), bucket_rows=3)
    _places(out)
    want = Counter(tuple(r) for r in odd.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == want
    assert "name" in out.columns and out.columns[-2:] == ["shard", "slot"]


def test_empty(empty):
    assert sharding.external_shuffle(empty.drop("shard")).count() == 0


def test_table(spark):
    out = queries.op7_sharding(spark, SF01)
    _places(out)
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF01, "documents").collect()}
    got = out.collect()
    assert len(got) == len(docs) and {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_seed_decides_and_buckets_are_shuffled(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "string(id) as text").repartition(7)
    once, again = (sharding.external_shuffle(docs, seed=1, bucket_rows=200).select("doc_id", "shard", "slot") for _ in "ab")
    other = sharding.external_shuffle(docs, seed=2, bucket_rows=200).select("doc_id", "shard", "slot")
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in again.collect())
    assert a != sorted(tuple(r) for r in other.collect())
    order = [d for d, _, _ in sorted(a, key=lambda r: (r[2], r[1]))]
    rising = sum(x < y for x, y in zip(order, order[1:]))
    assert 0.42 < rising / len(order) < 0.58


def test_the_permutation_is_spark_shuffle_of_sorted_buckets(spark):
    """Recomputed on the driver: buckets by hash, in key order, permuted by Spark's seeded shuffle, one after another."""
    from pyspark.sql import functions as F
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id % 90) as text")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.external_shuffle(docs, seed=5, bucket_rows=60).collect()}
    n = -(-500 // 60)
    at = docs.select("doc_id", F.pmod(F.xxhash64(F.lit(5), "doc_id", F.xxhash64("text"), F.lit(-1).cast("long")), F.lit(n)).alias("b"))
    buckets = defaultdict(list)
    for r in at.collect():
        buckets[r["b"]].append(r["doc_id"])
    order = [x for b in sorted(buckets) for x in sorted(buckets[b])]
    assert sorted(order) == list(range(500))
    places = {d: 16 * slot + shard for d, (shard, slot) in got.items()}
    done = 0
    for b in sorted(buckets):
        size = len(buckets[b])
        assert {places[d] for d in buckets[b]} == set(range(done, done + size))
        done += size


def test_a_hot_key_is_parted(spark):
    from pyspark.sql import functions as F
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.lit(None)).alias("text"))
    out = sharding.external_shuffle(docs, bucket_rows=100)
    _places(out)
    assert Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == Counter(tuple(r) for r in docs.collect())
    # The two null-keyed thousands do not stand together: the shuffled sequence mixes them with the others.
    order = [r["doc_id"] is None for r in out.orderBy("slot", "shard").collect()]
    runs = sum(a != b for a, b in zip(order, order[1:]))
    assert runs > 800


def test_partitions_at_scale():
    assert sharding.partitions(100 * 10**12 // sharding.BUCKET_BYTES, 100 * 10**12, 100_000) < 500_000
    assert sharding.partitions(126, 500 << 20, 51) == 32 and sharding.partitions(1, 0, 8) == 1


def test_write_shards(spark, tmp_path):
    docs = table(spark, SF01, "documents")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16
