"""Centroid clustering with Yinyang bounds.

The vectors become integers once, and every round is one pass over a table that holds each
vector with its centroid, an upper bound of the distance to it and one lower bound for each
group of centroids. Centroids are put into groups once, before the first round. A round
moves the bounds by how far centroids went; a vector whose upper bound is below all its
lower bounds keeps its centroid (the global filter), else only groups whose lower bound is
not above the upper one are looked at (the group filter), and of their centroids only those
that the bound less their own move doesn't exclude are measured, exactly. Squared distances
of integers are exact, and bounds are widened by more than their rounding, so the result is
that of measuring every pair.

What the driver holds: the centroids, and one sum for each centroid and component. Tasks
add their vectors up before anything is shuffled. Each round is written to the shared
folder and the one before it deleted.

Defined results. Vectors that are null, have another number of components, or a null or
non-finite one: left out. Null ids: clustered, but start a centroid only where too few ids
are there. Repeated ids and vectors: each row counts. Fewer vectors than centroids: as many
centroids as vectors. Ties: the smaller centroid. Components of more than 2**22 as
integers: measured with integers of any size, without bounds; a distance or inertia beyond
a long is null. Empty table: no rows. Other columns, of any name: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SCALE = 256.0
#: Up to here squared distances of some thousand components are exact in doubles.
ORDINARY = 1 << 22
#: More than the rounding of a distance and a sum; bounds are widened by it.
SLACK = 1e-9
LIMB = 40
LONG = (1 << 63) - 1
#: Vectors, or pairs of a vector and a centroid, that are measured at once.
ROWS = 4_096


@dataclass
class Clusters:
    rows: DataFrame  # id, cluster, distance
    centroids: list[list[int]]
    inertia: list[int | None]  # of each cluster; null beyond a long


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids; doubles hold them exactly, as components are small integers."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]


def exact_pairs(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), ROWS):
        gap = x[i[k : k + ROWS]] - c[j[k : k + ROWS]]
        out[k : k + ROWS] = np.einsum("ij,ij->i", gap, gap)
    return out


def grouped(c: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of clustering among the centroids."""
    heads = c[: max(1, groups)].copy()
    own = np.zeros(len(c), dtype=np.int64)
    for _ in range(rounds):
        own = exact(c, heads).argmin(1)
        for g in range(len(heads)):
            if (own == g).any():
                heads[g] = c[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


class Bounds:
    """Of the vectors of a batch: their centroid, an upper bound of its distance, and a lower bound for each group without it."""

    def __init__(self, c: np.ndarray, groups: np.ndarray):
        self.c, self.groups = c, groups
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]

    def _lower(self, low: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        low[np.arange(len(low)), cluster] = np.inf
        return np.stack([low[:, m].min(1) for m in self.members], axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = exact(x, self.c)
        cluster = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(d)), cluster]) * (1 + SLACK)
        return cluster, upper, self._lower(np.sqrt(d) * (1 - SLACK), cluster)

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after all centroids moved by ``drift``; and how many distances were measured."""
        cluster = cluster.copy()
        moved = np.array([drift[m].max() for m in self.members])
        upper = (upper + drift[cluster]) * (1 + SLACK)
        before, lower = lower, np.maximum(lower - moved[None, :], 0) * (1 - SLACK)
        rows = np.flatnonzero(upper >= lower.min(1))  # the global filter
        best = exact_pairs(x, self.c, rows, cluster[rows])
        measured = len(rows)
        upper[rows] = np.sqrt(best) * (1 + SLACK)
        still = upper[rows] >= lower[rows].min(1)
        rows, best = rows[still], best[still]
        old = cluster[rows]
        low = lower[rows][:, self.groups]
        low[np.arange(len(rows)), old] = np.sqrt(best) * (1 - SLACK)
        found = old.copy()
        for g, members in enumerate(self.members):
            at = np.flatnonzero(lower[rows, g] <= np.sqrt(best) * (1 + SLACK))  # the group filter
            if not len(at):
                continue
            left = np.maximum(before[rows[at], g][:, None] - drift[members][None, :], 0) * (1 - SLACK)
            open_ = (left <= (np.sqrt(best[at]) * (1 + SLACK))[:, None]) & (members[None, :] != old[at][:, None])
            i, j = np.nonzero(open_)
            d = exact_pairs(x, self.c, rows[at[i]], members[j])
            measured += len(d)
            whole = np.full(open_.shape, np.inf)
            whole[i, j] = d
            shut = ~open_ & (members[None, :] != old[at][:, None])
            own = low[at[:, None], members[None, :]]
            own = np.where(open_, np.sqrt(whole) * (1 - SLACK), np.where(shut, left, own))
            low[at[:, None], members[None, :]] = own
            k = whole.argmin(1)
            value = whole[np.arange(len(at)), k]
            better = (value < best[at]) | ((value == best[at]) & (members[k] < found[at]))
            best[at[better]], found[at[better]] = value[better], members[k[better]]
        cluster[rows] = found
        upper[rows] = np.sqrt(best) * (1 + SLACK)
        if len(rows):
            lower[rows] = self._lower(low, found)
        return cluster, upper, lower, measured


def _any_size(x: list[list[int]], c: list[list[int]]) -> tuple[list[int], list[int]]:
    """Cluster and squared distance of vectors, by integers of any size."""
    own = [min((sum((a - b) ** 2 for a, b in zip(v, u, strict=True)), j) for j, u in enumerate(c)) for v in x]
    return [j for _, j in own], [d for d, _ in own]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, wide = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * wide, max(wide, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _integers(dims: int, scale: float):
    """id, v (small integers) or big (others, as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("vec"), dims)
            with np.errstate(over="ignore"):
                x = np.floor(raw * scale)
            small = np.abs(x).max(1) <= ORDINARY
            ids = batch.column("id")
            if small.any():
                n = int(small.sum())
                yield pa.record_batch([ids.filter(pa.array(small)), _lists(x[small].astype(np.int32), pa.int32()), pa.nulls(n, pa.list_(pa.string()))], names=["id", "v", "big"])
            if not small.all():
                # A double of 2**53 or more is an integer already; its multiple may be none.
                big = [[str(int(a) * int(scale) if abs(a) >= 1 << 53 else int(b)) for a, b in zip(v, w, strict=True)] for v, w in zip(raw[~small], x[~small], strict=True)]
                yield pa.record_batch([ids.filter(pa.array(~small)), pa.nulls(len(big), pa.list_(pa.int32())), pa.array(big, pa.list_(pa.string()))], names=["id", "v", "big"])

    return run


STATE = "id bigint, v array<int>, big array<string>, cluster int, upper double, lower array<double>, distance bigint"


def _assigner(shared, last: bool):
    """One round: shared has the centroids, the ones before (null in the first round) and their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old, groups = shared.value
        fits = all(abs(a) <= ORDINARY for c in (new, old or []) for v in c for a in v)
        if fits:
            c = np.array(new, dtype=np.float64)
            bounds = Bounds(c, groups)
            drift = None if old is None else np.sqrt(((c - np.array(old, dtype=np.float64)) ** 2).sum(1)) * (1 + SLACK)
        names = ["id", "v", "big", "cluster", "upper", "lower", "distance"]
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                small = batch.column("v").is_valid()
                own = batch.filter(small)
                if fits and own.num_rows:
                    x = _matrix(own.column("v"), c.shape[1]).astype(np.float64)
                    if drift is None or own.column("upper").null_count:
                        cluster, upper, lower = bounds.first(x)
                    else:
                        state = (own.column("cluster").to_numpy().astype(np.int64), own.column("upper").to_numpy(), _matrix(own.column("lower"), len(bounds.members)))
                        cluster, upper, lower, _ = bounds.again(x, *state, drift)
                    far = pa.array(exact_pairs(x, c, np.arange(len(x)), cluster).astype(np.int64)) if last else pa.nulls(len(x), pa.int64())
                    yield pa.record_batch([own.column("id"), own.column("v"), own.column("big"), pa.array(cluster.astype(np.int32)), pa.array(upper), _lists(lower, pa.float64()), far], names=names)
                rest = batch if not fits else batch.filter(pa.array(~small.to_numpy(zero_copy_only=False)))
                if rest.num_rows:
                    x = [v if v is not None else list(map(int, b)) for v, b in zip(rest.column("v").to_pylist(), rest.column("big").to_pylist(), strict=True)]
                    cluster, far = _any_size(x, new)
                    n = len(x)
                    yield pa.record_batch([rest.column("id"), rest.column("v"), rest.column("big"), pa.array(cluster, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.array([d if d <= LONG else None for d in far], pa.int64())], names=names)

    return run


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _summer(dims: int):
    """(cluster, limb, n, sums): what a task adds up, in digits of 2**LIMB so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        large: dict[int, list[int]] = {}
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            small = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("v").filter(pa.array(small)), dims).astype(np.int64)
            for j in np.unique(cluster).tolist():
                counts[j] = counts.get(j, 0) + int((cluster == j).sum())
                sums[j] = sums.get(j, 0) + x[cluster[small] == j].sum(0)
            for j, b in zip(cluster[~small].tolist(), batch.column("big").filter(pa.array(~small)).to_pylist(), strict=True):
                large[j] = [a + int(t) for a, t in zip(large.get(j, [0] * dims), b, strict=True)]
        out: list[tuple[int, int, int, list[int]]] = []
        for j, n in counts.items():
            digits = [_limbs(int(a) + b) for a, b in zip(sums[j], large.get(j, [0] * dims), strict=True)]
            for limb in range(max(map(len, digits))):
                out.append((j, limb, n if limb == 0 else 0, [d[limb] if limb < len(d) else 0 for d in digits]))
        if out:
            a, b, n, s = zip(*out, strict=True)
            yield pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["cluster", "limb", "n", "sums"])

    return run


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each cluster; an empty one stays where it is."""
    dims = len(centroids[0])
    parts = state.select("cluster", "v", "big").mapInArrow(_summer(dims), "cluster int, limb int, n bigint, sums array<bigint>")
    found = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(dims))).alias("sums")).collect()  # a row for each centroid and digit
    totals, counts = {}, {}
    for r in found:
        whole = totals.setdefault(r["cluster"], [0] * dims)
        totals[r["cluster"]] = [a + (b << (LIMB * r["limb"])) for a, b in zip(whole, r["sums"], strict=True)]
        counts[r["cluster"]] = counts.get(r["cluster"], 0) + r["n"]
    return [[a // counts[j] for a in totals[j]] if counts.get(j) else c for j, c in enumerate(centroids)]


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = SCALE, salt: str = "2:", groups: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """Centroids after ``rounds`` rounds, and every vector's nearest one with its squared distance.

    The first centroids are the vectors whose hash of ``salt`` and id is smallest. groups: of
    centroids; a tenth as many, if none is given.
    """
    spark = table.sparkSession
    raw = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = (F.size("vec") == dims) & F.forall("vec", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    raw = raw.where(F.col("vec").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    rows, path = stored(raw.mapInArrow(_integers(dims, scale), "id bigint, v array<int>, big array<string>"), "integers")
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(F.asc_nulls_last(order), "v", "big").limit(k).collect()  # k rows
    new = [r["v"] if r["v"] is not None else list(map(int, r["big"])) for r in seeds]
    state = rows.selectExpr("*", "cast(null as int) cluster", "cast(null as double) upper", "cast(null as array<double>) lower", "cast(null as bigint) distance")
    if not new:
        return Clusters(state.select("id", "cluster", "distance"), [], [])
    small = np.array([[max(-ORDINARY, min(ORDINARY, a)) for a in v] for v in new], dtype=np.float64)
    group = grouped(small, groups or max(1, round(k / 10)))
    old = None
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast((new, old, group))  # two tables of centroids
        state, written = stored(state.mapInArrow(_assigner(shared, n == rounds), STATE), "clusters")
        discard(spark, path)
        path = written
        if n < rounds:
            old, new = new, moved(state, new)
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count("*").alias("all")).collect()  # a row for each centroid
    by = {r["cluster"]: int(r["s"]) if r["n"] == r["all"] and r["s"] <= LONG else None for r in sums}
    return Clusters(state.select("id", "cluster", "distance"), new, [by.get(j, 0) for j in range(len(new))])
