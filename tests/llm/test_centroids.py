import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.llm.centroids import LONG, Bounds, cluster, exact, grouped
from lexspark.llm.queries import op12_centroids

ROW = "vec_id bigint, embedding array<double>, cluster int, id string, upper double, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5, "y") for i, v in rows], ROW)


def brute(rows, k, rounds, dims, salt="2:"):
    """Every distance, by integers of any size."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(a is not None and math.isfinite(a) for a in v):
            kept.append((i, [math.floor(256 * a) if abs(a) < 2**53 else 256 * int(a) for a in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, u, strict=True)), j) for j, u in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), c


def same(found, want):
    rows, centroids = want
    got = sorted(((r["id"], r["cluster"], r["distance"]) for r in found.rows.collect()), key=repr)
    assert got == sorted(((i, j, d if d <= LONG else None) for i, j, d in rows), key=repr)
    assert found.centroids == centroids
    sums = [sum(d for _, j, d in rows if j == c) for c in range(len(centroids))]
    assert found.inertia == [s if s <= LONG and all(d <= LONG for _, j, d in rows if j == c) else None for c, s in enumerate(sums)]


def test_equals_measuring_every_pair(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(9, 8))
    rows = [(i, (heads[i % 9] + 0.4 * rng.normal(size=8)).tolist()) for i in range(600)] + [(i, [0.25] * 8) for i in range(600, 900)]  # a third is one vector
    same(cluster(table(spark, rows).repartition(5), k=12, rounds=5, dims=8), brute(rows, 12, 5, 8))


def test_odd_rows(spark):
    rows = [(1, [0.5, -1.5]), (1, [0.5, -1.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [3.0, 3.0]), (7, []), (8, [3.0, 3.0]), (9, [0.0, 0.0])]
    same(cluster(table(spark, rows), k=3, rounds=4, dims=2), brute(rows, 3, 4, 2))
    same(cluster(table(spark, rows), k=40, rounds=2, dims=2), brute(rows, 40, 2, 2))  # fewer vectors than centroids, and equal ones


def test_components_of_any_size(spark):
    rows = [(1, [1e300, -1e300]), (2, [1e18, 7.0]), (3, [2.0**60, 1.0]), (4, [0.5, 0.5]), (5, [1.7976931348623157e308, 0.0]), (6, [20_000.5, -20_000.25]), (7, [0.25, 0.25]), (8, [-3e5, 1e5])]
    same(cluster(table(spark, rows), k=3, rounds=3, dims=2), brute(rows, 3, 3, 2))
    small = [r for r in rows if r[0] in (4, 7)] + [(10 + i, [i / 7, -i / 3]) for i in range(30)] + [(2, [1e18, 7.0])]
    same(cluster(table(spark, small), k=4, rounds=3, dims=2), brute(small, 4, 3, 2))


def test_empty_table(spark):
    found = cluster(table(spark, [(1, [1.0, 2.0])]).where("vec_id < 0"), dims=2)
    assert found.rows.count() == 0 and found.centroids == [] and found.inertia == []


def test_query_on_few_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)] + [(500, None)]
    table(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centroids = brute(rows, 40, 5, 64)
    found = {r["vec_id"]: r for r in op12_centroids(spark, str(tmp_path)).collect()}
    assert len(found) == 120
    for i, j, d in want:
        r = found[i]
        assert (r["cluster"], r["distance"]) == (j, d)
        assert r["cluster_inertia"] == sum(x for _, c, x in want if c == j) and r["inertia"] == sum(x for _, _, x in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 5))
def test_bounds_never_change_the_result(seed, k, groups):
    """Rounds of moving centroids, with many ties: the clusters are those of all distances, and bounds hold."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(60, 3)).astype(float)
    c = rng.integers(-3, 4, size=(k, 3)).astype(float)
    group = grouped(c, groups)
    own, upper, lower = Bounds(c, group).first(x)
    for _ in range(4):
        new = c + rng.integers(-1, 2, size=c.shape) * (rng.random((k, 1)) < 0.6)
        drift = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9)
        c = new
        own, upper, lower, _ = Bounds(c, group).again(x, own, upper, lower, drift)
        d = exact(x, c)
        assert (own == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(60), own] * (1 - 1e-12)).all()
        root[np.arange(60), own] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= root[:, group == g].min(1) * (1 + 1e-12)).all()


def test_filters_save_distances():
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(20, 16)) * 50
    x = np.floor(heads[rng.integers(0, 20, 2_000)] + rng.normal(size=(2_000, 16)))
    c = np.floor(heads)
    b = Bounds(c, grouped(c, 4))
    state = b.first(x)
    *_, measured = b.again(x, *state, np.full(20, 0.5))
    assert measured < 0.05 * len(x) * 20


@pytest.mark.parametrize("value", [0, 1, -1, 2**39, -(2**40), 2**130 - 7, -(2**90)])
def test_digits(value):
    from lexspark.llm.centroids import LIMB, _limbs

    assert sum(d << (LIMB * k) for k, d in enumerate(_limbs(value))) == value and all(abs(d) < 1 << LIMB for d in _limbs(value))
