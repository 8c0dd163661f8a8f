"""Approximate nearest neighbours by balanced posting lists (largest inner product).

1. Equal vectors are one class with its k + 1 smallest ids: a vector of any number of rows
   is searched and stored once, and no neighbour is lost by it.
2. Inner product becomes distance by one more component, sqrt(M^2 - |x|^2), with M the
   largest norm; queries have 0 there. Balanced centroids are fitted on a bounded sample,
   the ``sample`` classes with the smallest hashes of their ids.
3. Every class goes to the list of its nearest centroid, and a boundary class also to the
   lists of further centroids, ``copies`` at most, within a ratio of the least distance.
4. A query walks a graph over the centroids, held in memory, and takes the lists whose
   centroid is within a ratio of the least distance. That ratio is calibrated on the
   sample for the target recall. A query that stands alone goes on, in the order of
   distance, until its lists surely hold ``k`` + 1 classes or it has taken all.
5. A list is searched by itself, a long one in chunks of ``CHUNK`` classes, so the work is
   dealt to as many tasks as there are lists. A task keeps a running top k of each query
   over the lists it searches, and those of all tasks are merged. Products are of the
   original vectors in double precision.

Bounds. Centroids are fitted on ``sample`` classes and number sqrt(n), ``MOST_LISTS`` at
most (from 16.7 million vectors on): lists are longer then and a query reads more chunks,
in more tasks; no vector is left out.

Defined results. Vectors that are null, zero, of another than the most frequent length, or
that hold null or non-finite components take no part. Null ids take no part. Repeated ids:
each row is a candidate. Ties: smaller id. Fewer candidates than k: all of them. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 20
EVERY = 20
SAMPLE = 32_768
MOST_LISTS = 4096
COPIES = 4
BOUNDARY = 1.05
RECALL = 0.985
CHUNK = 4_096
#: Queries whose best candidates a task holds.
HELD = 50_000


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of a to each of b."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _slices(n: int, size: int = 2_048) -> Iterator[slice]:
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means whose assignment charges for full clusters."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)].copy()
    load = np.zeros(len(c))
    for _ in range(rounds):
        owner = np.empty(len(x), dtype=np.int64)
        charge = None
        for part in _slices(len(x)):
            d = _near(x[part], c) ** 2
            if charge is None:
                charge = 0.1 * np.median(d) * (load / max(1.0, len(x) / len(c)) - 1).clip(0, 10)[None, :]
            owner[part] = (d + charge).argmin(1)
        load = np.bincount(owner, minlength=len(c)).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, owner, x)
        c = np.where(load[:, None] > 0, total / np.maximum(load, 1)[:, None], c)
    return c


@dataclass
class Index:
    """Centroids (with the extra component), their graph, the ratio, and how many classes each list has."""

    centroids: np.ndarray
    edges: list[np.ndarray]
    top: float
    ratio: float
    sizes: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))[:, None]], axis=1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Where each vector is posted."""
        out: list[np.ndarray] = []
        for part in _slices(len(x)):
            d = _near(self.lifted(x[part]), self.centroids)
            order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
            ahead = np.take_along_axis(d, order, axis=1)
            out += [o[a <= BOUNDARY * a[0]] for o, a in zip(order, ahead, strict=True)]
        return out

    def chunks(self) -> np.ndarray:
        """How many chunks a list is searched in."""
        return np.maximum(1, -(-self.sizes // CHUNK))

    def walk(self, q: np.ndarray, need: int) -> list[int]:
        """Lists within the ratio of the nearest centroid, met on a best-first walk of the graph.

        The walk goes on until those lists hold ``need`` different classes (a class is in
        COPIES lists at most), or it has seen all.
        """
        q = np.concatenate([q, [0.0]])
        start = 0
        dist = {start: float(np.linalg.norm(self.centroids[start] - q))}
        queue, best = [(dist[start], start)], dist[start]
        seen: list[tuple[float, int]] = []
        while queue:
            d, at = heapq.heappop(queue)
            # Nothing beyond the ratio is worth a step, once enough is known to be no further than this.
            if d > max(self.ratio, 1.1) * best * 1.02 and sum(n for x, n in seen if x <= d) >= need * COPIES:
                break
            seen.append((d, int(self.sizes[at])))
            new = np.array([e for e in self.edges[at] if e not in dist], dtype=np.int64)
            if len(new):
                for e, x in zip(new.tolist(), np.sqrt(((self.centroids[new] - q) ** 2).sum(1)).tolist(), strict=True):
                    dist[e] = x
                    best = min(best, x)
                    heapq.heappush(queue, (x, e))
        near = sorted(dist, key=lambda e: (dist[e], e))
        chosen, held = [], 0
        for e in near:
            if dist[e] > self.ratio * best and held >= need * COPIES:
                break
            chosen.append(e)
            held += int(self.sizes[e])
        return sorted(e for e in chosen if self.sizes[e])


def graph(c: np.ndarray, degree: int = 16) -> list[np.ndarray]:
    """Nearest centroids of each, in both directions, and a ring so that all can be reached."""
    edges: list[set[int]] = [set() for _ in c]
    for part in _slices(len(c)):
        order = np.argsort(_near(c[part], c), axis=1, kind="stable")[:, 1 : degree + 1]
        for i, o in enumerate(order.tolist(), part.start):
            for j in o:
                edges[i].add(j)
                edges[j].add(i)
            edges[i].add((i + 1) % len(c))
    return [np.array(sorted(e - {i}), dtype=np.int64) for i, e in enumerate(edges)]


def fit(x: np.ndarray, top: float, lists: int, k: int, recall: float) -> Index:
    """Centroids, graph and the ratio that the sample needs for the recall."""
    index = Index(np.zeros((1, x.shape[1] + 1)), [np.zeros(0, np.int64)], top, np.inf, np.zeros(1, np.int64))
    index.centroids = balanced_centroids(index.lifted(x), lists)
    index.edges = graph(index.centroids)
    posted = index.lists_of(x)
    queries = x[:: max(1, len(x) // 400)]
    d = _near(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), index.centroids)
    d /= np.maximum(d.min(axis=1, keepdims=True), 1e-12)
    need = []
    for i, q in enumerate(queries):
        score = x @ q
        for j in np.argpartition(-score, min(k, len(x) - 1))[: k + 1]:
            need.append(d[i][posted[j]].min())
    index.ratio = float(np.quantile(need, recall)) + 1e-6
    return index


def _poster(shared):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
                found = index.lists_of(x)
                row = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                yield pa.record_batch([pa.array(np.concatenate(found), pa.int32()), batch.column("cid").take(pa.array(row))], names=["list", "cid"])

    return post


def _router(shared, need: int):
    """A row for each query and chunk that it searches."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        chunks = index.chunks()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a query has many rows, so few queries at a time
                part = batch.slice(at, 64)
                rows, lists, parts = [], [], []
                for i, q in enumerate(part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)):
                    for x in index.walk(q, need):
                        n = int(chunks[x])
                        rows += [i] * n
                        lists += [x] * n
                        parts += range(n)
                of = pa.array(rows, pa.int64())
                yield pa.record_batch([pa.array(lists, pa.int32()), pa.array(parts, pa.int32()), part.column("cid").take(of), part.column("vec").take(of)], names=["list", "chunk", "cid", "vec"])

    return route


def best(q: np.ndarray, x: np.ndarray, cid: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, products) of the k best rows of x for each query, ties to the smaller class."""
    score = q @ x.T
    most = min(len(cid), k)
    last = np.partition(score, len(cid) - most, axis=1)[:, len(cid) - most]
    slack = 1e-12 * (1 + np.abs(score).max(axis=1))  # fast products may differ from exact ones in the last places
    for i in range(len(q)):
        at = np.flatnonzero(score[i] >= last[i] - slack[i])
        exact = (x[at] * q[i]).sum(axis=1)  # one order of summation for every pair
        first = np.lexsort([cid[at], -exact])[:k]
        yield cid[at[first]], exact[first]


def _searcher(k: int, dims: int):
    def rows(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = [len(c) for c, _ in held.values()]
        cids, scores = (np.concatenate(x) if held else np.zeros(0) for x in zip(*held.values(), strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0))
        return pa.record_batch([pa.array(np.repeat(np.array(list(held), dtype=np.int64), n)), pa.array(cids.astype(np.int64)), pa.array(scores, pa.float64())], names=["qcid", "cid", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, stored_cid, stored_x, ready = None, [], [], None
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(c).to_numpy() for c in ("list", "chunk", "kind")], axis=1)
            cids = batch.column("cid").to_numpy()
            vecs = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, dims)
            cut = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(axis=1)])).tolist()
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                now = tuple(heads[a, :2].tolist())
                if now != unit:
                    unit, stored_cid, stored_x, ready = now, [], [], None
                if heads[a, 2] == 0:
                    stored_cid.append(cids[a:b])
                    stored_x.append(vecs[a:b])
                elif stored_cid:
                    if ready is None:
                        ready = np.concatenate(stored_x), np.concatenate(stored_cid)
                    for at in range(a, b, 64):
                        end = min(b, at + 64)
                        for q, (c, s) in zip(cids[at:end].tolist(), best(vecs[at:end], *ready, k), strict=True):
                            if q in top:
                                old_c, old_s = top[q]
                                fresh = ~np.isin(c, old_c)
                                c, s = np.concatenate([old_c, c[fresh]]), np.concatenate([old_s, s[fresh]])
                                first = np.lexsort([c, -s])[:k]
                                c, s = c[first], s[first]
                            top[q] = c, s
                    if len(top) > HELD:
                        yield rows(top)
                        top = {}
        if top:
            yield rows(top)

    return search


def search(table: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    raw = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    fine = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    raw = raw.where(F.coalesce(fine, F.lit(False)))
    sizes = raw.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 1
    rows = materialise(raw.where(F.size("vec") == dims).withColumn("vec", F.transform("vec", lambda v: v + 0.0)), "vectors")

    first = Window.partitionBy("vec").orderBy("id")
    ranked = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = materialise(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "vec"), "classes")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v, lambda s: F.sqrt(s))
    n, top = classes.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(1.0))).first()
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").toArrow().column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    lists = int(min(MOST_LISTS, max(1, round(n**0.5)), max(1, len(picked) // 8)))
    index = fit(picked, top, lists, k, recall) if n else Index(np.zeros((1, dims + 1)), [np.zeros(0, np.int64)], 1.0, 1.0, np.zeros(1, np.int64))
    shared = spark.sparkContext.broadcast(index)

    posted = materialise(classes.select("cid", "vec").mapInArrow(_poster(shared), "list int, cid bigint"), "postings")
    sized = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each centroid
    index.sizes = np.array([sized.get(x, 0) for x in range(len(index.centroids))], dtype=np.int64)
    shared = spark.sparkContext.broadcast(index)
    homes = spark.createDataFrame(list(enumerate(index.chunks().tolist())), "list int, chunks int")
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    stored = posted.join(F.broadcast(homes), "list").select("list", chunk.alias("chunk"), "cid").join(classes.select("cid", "vec"), "cid")

    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    owned = materialise(asked.join(classes.hint("merge"), F.col("qvec") == F.col("vec")).select("query_id", F.col("cid").alias("qcid")), "queries")
    asking = classes.join(owned.select(F.col("qcid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vec")
    routed = asking.mapInArrow(_router(shared, k + 1), "list int, chunk int, cid bigint, vec array<double>")
    mixed = stored.select("list", "chunk", F.lit(0).alias("kind"), "cid", "vec").unionByName(routed.select("list", "chunk", F.lit(1).alias("kind"), "cid", "vec"))
    mixed = mixed.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind")
    found = materialise(mixed.mapInArrow(_searcher(k + 1, dims), "qcid bigint, cid bigint, score double"), "candidates").distinct()

    ahead = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    nearest = found.withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= k + 1).join(classes.select("cid", "ids"), "cid").select("qcid", "score", F.explode("ids").alias("id"))
    ahead = Window.partitionBy("qcid").orderBy(F.desc("score"), "id")
    nearest = nearest.withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= k + 1)
    answers = materialise(nearest.groupBy("qcid").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")), "answers")
    others = owned.join(answers.hint("merge"), "qcid").select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
