import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from almacen.llm import vector_codes
from almacen.llm.vector_codes import MaskIndex


def _nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return d.index(min(d)), min(d)


@pytest.mark.parametrize("entries, dims, spread", [(64, 4, 20), (64, 1, 5), (64, 8, 300), (3, 4, 2), (1, 2, 9), (64, 4, 1 << 26)])
def test_masks_find_the_nearest_entry(entries, dims, spread):
    rnd = np.random.default_rng(entries + dims)
    book = rnd.integers(-spread, spread + 1, (entries, dims))
    x = np.concatenate([rnd.integers(-spread, spread + 1, (300, dims)), book])
    found, apart = MaskIndex(book).nearest(x)
    assert list(zip(found.tolist(), apart.tolist())) == [_nearest(r, book.tolist()) for r in x.tolist()]


def test_masks_leave_far_entries_out():
    rnd = np.random.default_rng(5)
    book, x = rnd.integers(-100, 100, (64, 4)), rnd.integers(-100, 100, (500, 4))
    index = MaskIndex(book)
    radius = index.radius(x)
    mask = index.candidates(x, radius)
    for row, r, m in zip(x, radius, mask):
        inside = np.flatnonzero((np.abs(book - row) <= r).all(axis=1))
        assert int(m) == sum(1 << int(i) for i in inside)
    assert np.bitwise_count(mask).mean() < 32


def _plain(rows):
    """The contract in plain Python over ``(vec_id, embedding, label)``."""
    kept = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    part = len(kept[0][1]) // 16
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[v[p * part:(p + 1) * part] for _, v, _ in first] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            parts = [v[p * part:(p + 1) * part] for _, v, _ in kept]
            groups = defaultdict(list)
            for x in parts:
                groups[_nearest(x, books[p])[0]].append(x)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old
                        for e, old in enumerate(books[p])]
    coded = []
    for i, v, lab in kept:
        near = [_nearest(v[p * part:(p + 1) * part], books[p]) for p in range(16)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near), lab))
    per = Counter()
    for _, _, e, lab in coded:
        per[lab] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, c, e, per[lab], sha) for i, c, e, lab in coded)


def _rows(n, seed):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(c)) for c in rnd.normal(0, 0.3, 32)], int(i % 3) if i % 3 else None) for i in range(n)]
    same = rows[5][1]
    rows += [(1000 + i, same, 7) for i in range(n // 2)]                                    # one vector of a third of all rows
    rows += [(5, rows[6][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None)]              # repeated and null ids
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.1] * 31 + [float("nan")], 1),
             (2003, [0.1] * 31 + [None], 2), (2004, [float("-inf")] * 32, 2)]
    return rows


def _got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n", [12, 150])
def test_odd_rows_equal_the_plain_version(spark, n):
    rows = _rows(n, n)
    df = spark.createDataFrame([(*r, "clash", [1], "v") for r in rows],
                               "vec_id long, embedding array<float>, label int, code string, v array<int>, error string")
    assert _got(vector_codes.compress(df)) == _plain(rows)


def test_other_lengths_and_large_components(spark):
    rows = [(i, [float(i + k) for k in range(16)], 0) for i in range(5)] + [(9, [1.0] * 32, 0), (10, [1.0] * 15, 0)]
    rows += [(11, [3e38] + [0.0] * 15, 1)]
    out = {r["vec_id"]: r for r in vector_codes.compress(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 11]
    assert out[11]["error"] == 0 and out[11]["code"][:2] == "05"


def test_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [1.0] * 7, None)], schema)).count() == 0
