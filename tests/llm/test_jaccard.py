import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from samples import SF, SF01

from almacen.llm import jaccard, queries
from almacen.llm.common import table


def _check(df, docs, n=3, percent=90):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}
    assert got == brute.jaccard(docs, n, percent)


def test_odd_rows(odd):
    _check(jaccard.jaccard_components(odd), [tuple(r) for r in odd.select("doc_id", "text").collect()])


def test_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("sf", [SF, SF01])
def test_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    _check(queries.op8_jaccard_join(spark, sf), docs)


def _edited(seed, families, copies, words):
    """Families of texts at graded distances, many near the threshold."""
    rnd = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(*words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                k = rnd.randrange(len(w))
                w[k:k + rnd.randint(0, 1)] = [f"v{rnd.randint(0, 9)}"]
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_no_link_is_lost_near_the_threshold(spark, n, percent):
    rows = _edited(3, 25, 12, (3, 260))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check(jaccard.jaccard_components(docs, n, percent), rows, n, percent)


def test_a_large_group_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_DOCS", 12)
    rows = _edited(4, 2, 150, (60, 120))
    _check(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("percent", [90, 80])
def test_bands_and_buckets_cover_every_linked_pair(percent):
    sig = jaccard.Signatures(percent)
    rnd = np.random.default_rng(1)
    for size in (10, 19, 20, 57, 181, 900, 5000):
        for _ in range(40):
            a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64))
            most = 2 * size * (100 - percent) // (100 + percent) + 2
            d = int(rnd.integers(0, most + 1))
            drop = int(rnd.integers(0, d + 1))
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 1 << 63, d - drop, dtype=np.int64).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                assert len(np.intersect1d(sig(a), sig(b))), (size, d, drop)


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_a_bucket_is_linked_over_batches(rows):
    at, k1, known = [1, 1, 2, 3, 3, 3, 4, 4], [9, 8, 7, 6, 6, 5, 3, 2], [None, None, None, None, None, None, 1, None]
    table = pa.table({"at": pa.array(at, pa.int64()), "k1": pa.array(k1, pa.int64()), "known": pa.array(known, pa.int64())})
    empty = table.schema.empty_table().to_batches() or [pa.RecordBatch.from_pylist([], table.schema)]
    out = list(jaccard._bucket_links(empty + table.to_batches(max_chunksize=rows)))
    got = sorted((r["k1"], r["lead"]) for b in out for r in b.to_pylist())
    assert got == [(3, 1), (5, 6), (8, 9)]
    assert all(b.schema.types == [pa.int64(), pa.int64()] for b in out)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_packed_buckets_are_unpacked_whole(rows):
    """six bytes a signature go to disk, not eight and then some twenty; every two rows that share one are linked."""
    rnd = np.random.default_rng(2)
    pool = rnd.integers(-1 << 63, 1 << 63, 3000, dtype=np.int64)
    sets = [np.unique(rnd.choice(pool, k)) for k in rnd.integers(0, 60, 400)]
    packs = []
    for base, part in ((5 << 33, sets[:150]), ((5 << 33) + 150, sets[150:250]), (9 << 33, sets[250:])):
        place, at, own = jaccard._packed_buckets(base, part, 12)
        packs.append(pa.table({"place": pa.array(place), "node": pa.array(np.full(len(place), base)), "at": at, "own": own}))
    table = pa.concat_tables(packs).sort_by("place")
    assert sum(map(len, sets)) * 6 >= table["at"].combine_chunks().buffers()[2].size + table["own"].combine_chunks().buffers()[2].size
    known = [r for b in jaccard._bucket_links(jaccard._unpacked(table.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    node = [(5 << 33) + i for i in range(250)] + [(9 << 33) + i for i in range(150)]
    sigs = dict(zip(node, map(set, map(np.ndarray.tolist, sets))))
    first = {}
    for i, s in sigs.items():
        for x in s:
            first.setdefault(x, i)
    assert {(r["k1"], r["lead"]) for r in known} == {(i, first[x]) for i, s in sigs.items() for x in s if first[x] != i}


def test_signatures_move_in_few_bytes(spark, scratch):
    """near dedup filled the disk with a row per signature; now they are packed by place, with the profiles."""
    rows = _edited(5, 60, 5, (100, 300))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:50])] + [(None, rows[0][1]), (7000, None)]
    seen = []
    real = jaccard.staged
    jaccard.staged = lambda df, name: seen.append((name, out := real(df, name))) or out
    try:
        _check(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80),
               [r for r in rows if r[0] is not None], 5, 80)
    finally:
        jaccard.staged = real
    written = dict(seen)["jaccard-profiles"]
    assert "sigs" not in written.columns
    profile, packed = written.filter("place is null"), written.filter("place is not null")
    assert profile.count() == profile.select("node").distinct().count() == len(rows)
    sigs = jaccard.Signatures(80)
    total = sum(len(sigs(jaccard.Shingler(5)(t))) for _, t in rows)
    size = packed.selectExpr("sum(length(at) + length(own))").first()[0]
    assert 0 < size <= 6 * total


def test_a_chain_of_candidates_is_not_compared_as_a_whole(spark, monkeypatch):
    """sets that share some bucket each with a next one are one component, whose tiles took copies by its square."""
    monkeypatch.setattr(jaccard, "TILE_DOCS", 8)
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(300 + i, 300) for i in range(1, 6)], "k1 long, lead long")
    groups = {}
    for r in jaccard._gathered(chain).collect():
        groups.setdefault(r["grp"], []).append(r["node"])
    assert sorted(groups.pop(300)) == list(range(300, 306))
    assert {g: sorted(n) for g, n in groups.items()} == {i: [i, i + 1] for i in range(200)}


@pytest.mark.parametrize("tile", [2, 12])
def test_no_link_is_lost_in_a_chain(spark, monkeypatch, tile):
    """texts that share a passage hang together by some bucket; their links are the same however groups are cut."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for _ in range(60):
        base = passage[:rnd.randint(20, 40)] + [f"w{rnd.randint(0, 9999)}" for _ in range(rnd.randint(30, 80))]
        for _ in range(3):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(jaccard, "TILE_DOCS", tile)
    _check(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80), rows, 5, 80)
