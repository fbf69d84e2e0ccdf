"""Operator 11 against plain k-means in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from upshelf.llm import walsh

SCHEMA = "vec_id long, embedding array<float>, c string, distance long"


def _plain(rows, k=16, rounds=3, dim=64):
    kept = []
    for vid, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vid, [math.floor(64 * float(np.float32(x))) for x in v]))
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in sorted(seeds, key=lambda s: s[0])[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    sums = [sum(d for _, c, d in found if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, c, d, sums[c], sum(sums), sha[c]) for i, c, d in found], key=str)


def _got(df, **options):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                   for r in walsh.digests(df, **options).collect()], key=str)


def test_clusters_with_oddities(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(160, 64)).astype("float32") * rng.choice([0.01, 1, 50], size=(160, 1)).astype("float32")
    rows = [(i, v[i].tolist()) for i in range(160)]
    rows += [(i, v[7].tolist()) for i in range(200, 240)]                          # a group of copies, ties
    rows += [(3, v[3].tolist()), (None, v[4].tolist()), (500, None), (501, []), (502, [1.0] * 63), (503, [None] + [1.0] * 63),
             (504, [float("nan")] * 64), (505, [float("inf")] * 64), (506, [0.0] * 64)]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA)
    assert _got(df) == _plain(rows)


def test_clusters_of_large_numbers_few_rows_and_none(spark):
    rows = [(i, [float((i * 37 + j) % 11 - 5) * 300000.0 for j in range(64)]) for i in range(9)]     # beyond the 64-bit path
    df = spark.createDataFrame([(i, x, "", 1) for i, x in rows], SCHEMA)
    assert _got(df) == _plain(rows) and len(_got(df)) == 9
    assert _got(df.limit(0)) == []
    alone = spark.createDataFrame([(None, [1.0] * 64, "", 1)], SCHEMA)
    assert _got(alone) == [(None, None, None, None, None, None)]


def test_copies_of_one_vector_leave_clusters_empty(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    df = spark.createDataFrame([(i, x, "", 1) for i, x in rows], SCHEMA)
    got = _got(df)
    assert got == _plain(rows) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("dim", [1, 2, 64])
def test_transform_keeps_distances_and_goes_back(dim):
    rng = np.random.default_rng(dim)
    x, order = rng.integers(-1000, 1000, size=(20, dim)), walsh.sequency(dim)
    c = walsh.transform(x, order)
    assert (walsh.inverse(c, order) == x).all()
    assert (((c[:1] - c) ** 2).sum(axis=1) == dim * ((x[:1] - x) ** 2).sum(axis=1)).all()


def test_length_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        walsh.cluster(spark.createDataFrame([], SCHEMA), dim=48)
