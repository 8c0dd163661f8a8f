"""Expectation maximisation of a channel model, and decoding with it.

The model is a table (ilabel, olabel, p) of edits with one memory-less state; label "" is
the empty string. Pairs are aligned by dynamic programming, batch by batch; expectations
are small rows that a partial aggregation sums.
"""

from __future__ import annotations

import math
import random
import warnings
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import kept

Edits = dict[tuple[str, str], float]

MOST_ITERATIONS = 50
DELTA = 1e-4


def initial(spark: SparkSession, ilabels: list[str], olabels: list[str], seed: int | None = None, delta: float = 1e-3, insertions: bool = True, deletions: bool = True) -> DataFrame:
    """All edits alike, or with random probabilities in [delta, 1)."""
    rng = random.Random(seed)
    rows = [(a, b, rng.uniform(delta, 1) if seed is not None else 1.0) for a in [*ilabels, *([""] if insertions else [])] for b in [*olabels, *([""] if deletions else [])] if a or b]
    return m_step(spark.createDataFrame(rows, "ilabel string, olabel string, n double"))


def m_step(expected: DataFrame, by_state: bool = False) -> DataFrame:
    """(ilabel, olabel, p): expectations over their total, of the whole state or of each input label."""
    w = Window.partitionBy(*([] if by_state else ["ilabel"]))
    total = expected.agg(F.sum("n").alias("t")) if by_state else None
    if by_state:
        return expected.crossJoin(F.broadcast(total)).select("ilabel", "olabel", (F.col("n") / F.col("t")).alias("p"))
    return expected.select("ilabel", "olabel", (F.col("n") / F.sum("n").over(w)).alias("p"))


def expectations(x: list[str], y: list[str], p: Edits, viterbi: bool = False) -> tuple[dict[tuple[str, str], float], float]:
    """Expected number of each edit over the alignments of x and y, and their log-likelihood."""
    n, m = len(x), len(y)
    if viterbi:
        path, like = align(x, y, p)
        counts: dict[tuple[str, str], float] = defaultdict(float)
        for e in path:
            counts[e] += 1.0
        return counts, like
    cost = {e: math.log(q) for e, q in p.items() if q > 0}  # logarithms: long pairs would leave the range of plain numbers
    none = -math.inf
    both = [[cost.get((a, b), none) for b in y] for a in x]
    off, on = [cost.get((a, ""), none) for a in x], [cost.get(("", b), none) for b in y]

    def total_of(terms: list[float]) -> float:
        top = max(terms)
        return top if top == none else top + math.log(sum(math.exp(t - top) for t in terms))

    ahead = [[none] * (m + 1) for _ in range(n + 1)]
    back = [[none] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            terms = [0.0 if i == j == 0 else none]
            if i and j:
                terms.append(ahead[i - 1][j - 1] + both[i - 1][j - 1])
            if i:
                terms.append(ahead[i - 1][j] + off[i - 1])
            if j:
                terms.append(ahead[i][j - 1] + on[j - 1])
            ahead[i][j] = total_of(terms)
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            terms = [0.0 if (i, j) == (n, m) else none]
            if i < n and j < m:
                terms.append(back[i + 1][j + 1] + both[i][j])
            if i < n:
                terms.append(back[i + 1][j] + off[i])
            if j < m:
                terms.append(back[i][j + 1] + on[j])
            back[i][j] = total_of(terms)
    like = ahead[n][m]
    counts = defaultdict(float)
    if like == none:
        return counts, none
    for i in range(n + 1):
        for j in range(m + 1):
            a = ahead[i][j] - like
            if a == none:
                continue
            for there, edit, c, to in (
                (i < n and j < m, (x[i] if i < n else "", y[j] if j < m else ""), both[i][j] if i < n and j < m else none, (i + 1, j + 1)),
                (i < n, (x[i] if i < n else "", ""), off[i] if i < n else none, (i + 1, j)),
                (j < m, ("", y[j] if j < m else ""), on[j] if j < m else none, (i, j + 1)),
            ):
                if there and c > none and (after := back[to[0]][to[1]]) > none:
                    counts[edit] += math.exp(a + c + after)
    return counts, like


def align(x: list[str], y: list[str], p: Edits) -> tuple[list[tuple[str, str]], float]:
    """The best alignment, by a search ordered by cost with the least edit cost as the bound of what is left; ties by the edits."""
    cost = {e: -math.log(q) for e, q in p.items() if q > 0}
    queue: list[tuple[float, int, int, tuple]] = [(0.0, 0, 0, ())]
    seen: set[tuple[int, int]] = set()
    while queue:
        c, i, j, path = heappop(queue)
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(x) and j == len(y):
            return list(path), -c
        steps = []
        if i < len(x) and j < len(y):
            steps.append((x[i], y[j], 1, 1))
        if i < len(x):
            steps.append((x[i], "", 1, 0))
        if j < len(y):
            steps.append(("", y[j], 0, 1))
        for a, b, di, dj in steps:
            if (a, b) in cost:
                heappush(queue, (c + cost[a, b], i + di, j + dj, (*path, (a, b))))
    return [], -math.inf


def _collected(model: DataFrame, most: int = 1_000_000) -> Edits:
    rows = model.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the model is too large to send to all executors")
    return {(r["ilabel"], r["olabel"]): r["p"] for r in rows}


def grouped(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, n): each different pair once, with how often it occurs, dealt to all cores: aligning costs far more than reading."""
    spark = pairs.sparkSession
    few = pairs.groupBy(x, y).agg(F.count("*").alias("n"))
    return kept(few.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "pairs")


def e_step(pairs: DataFrame, model: Edits, x: str = "x", y: str = "y", viterbi: bool = False, times: str | None = None) -> DataFrame:
    """(ilabel, olabel, n) with the log-likelihood as the row (null, null, sum), and the number of pairs that no path joins as (null, 'lost', n).

    x, y: array<string> columns. times: a column that says how often each pair counts.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], float] = defaultdict(float)
        like, lost = 0.0, 0.0
        for batch in batches:
            many = batch.column(times).to_pylist() if times else [1] * batch.num_rows
            for a, b, m in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), many, strict=True):
                counts, ll = expectations(a or [], b or [], shared.value, viterbi)
                if ll > -math.inf:
                    like += m * ll
                else:
                    lost += m
                for e, c in counts.items():
                    total[e] += m * c
        rows = [*((a, b, c) for (a, b), c in total.items()), (None, None, like), (None, "lost", lost)]
        a, b, c = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=["ilabel", "olabel", "n"])

    return pairs.select(x, y, *([times] if times else [])).mapInArrow(run, "ilabel string, olabel string, n double").groupBy("ilabel", "olabel").agg(F.sum("n").alias("n"))


def train(pairs: DataFrame, start: DataFrame, iterations: int = MOST_ITERATIONS, delta: float = DELTA, alpha: float = 0.0, batches: int = 1, viterbi: bool = False, by_state: bool = False) -> tuple[DataFrame, list[float]]:
    """Iterates until the likelihood changes by less than delta (relative). Equal pairs are aligned once.

    alpha 0: full batches. Otherwise ``batches`` parts by hash in turn, and the model moves
    by nu = (k + 2)^-alpha towards each part's own.
    """
    spark = pairs.sparkSession
    model, history = _collected(start), []
    pairs = grouped(pairs)
    for k in range(min(iterations, MOST_ITERATIONS) * batches):
        part = pairs if batches == 1 else pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(batches)) == k % batches)
        found = e_step(part, model, viterbi=viterbi, times="n").collect()  # as many rows as edits
        like = next(r["n"] for r in found if r["ilabel"] is None and r["olabel"] is None)
        if lost := next(r["n"] for r in found if r["olabel"] == "lost" and r["ilabel"] is None):
            warnings.warn(f"the model has no path for {lost:.0f} pairs; they count for nothing", stacklevel=2)
        counts = {(r["ilabel"], r["olabel"]): r["n"] for r in found if r["ilabel"] is not None}
        sums: dict[str, float] = defaultdict(float)
        for (a, _), c in counts.items():
            sums["" if by_state else a] += c
        fresh = {e: c / sums["" if by_state else e[0]] for e, c in counts.items() if c}
        if alpha:
            nu = (k + 2) ** -alpha
            fresh = {e: (1 - nu) * model.get(e, 0.0) + nu * fresh.get(e, 0.0) for e in model.keys() | fresh.keys()}
        model = fresh
        history.append(like)
        if batches == 1 and len(history) > 1 and abs(history[-1] - history[-2]) <= delta * max(1.0, abs(history[-1])):
            break
    return spark.createDataFrame([(a, b, float(q)) for (a, b), q in model.items()], "ilabel string, olabel string, p double"), history


def restarts(pairs: DataFrame, ilabels: list[str], olabels: list[str], seeds: list[int], **options) -> tuple[DataFrame, float]:
    """The best of several trainings from random starts."""
    best = None
    for seed in seeds:
        model, history = train(pairs, initial(pairs.sparkSession, ilabels, olabels, seed), **options)
        if best is None or history[-1] > best[1]:
            best = (model, history[-1])
    return best


def decode(rows: DataFrame, channel: DataFrame, prior: dict[tuple[str, str], float], plain: list[str], column: str = "y", power: float = 1.0) -> DataFrame:
    """Adds ``decoded``: the plain sequence of the greatest prior (bigrams of labels, "" at the ends) times channel, one label for each."""
    shared = rows.sparkSession.sparkContext.broadcast((_collected(channel), prior))

    def best(y: list[str]) -> list[str]:
        p, q = shared.value
        log = lambda v: math.log(v) if v > 0 else -1e9
        front = {"": (0.0, [])}
        for c in y:
            front = {a: max(((s + log(q.get((h, a), 0.0)) + power * log(p.get((a, c), 0.0)), [*path, a]) for h, (s, path) in front.items()), key=lambda t: (t[0], t[1])) for a in plain}
        return max(((s + log(q.get((h, ""), 1e-9)), path) for h, (s, path) in front.items()), default=(0.0, []))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("decoded", pa.array([best(y or []) for y in batch.column(column).to_pylist()], pa.list_(pa.string())))

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.ArrayType(T.StringType()))]))


def aligned(pairs: DataFrame, model: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``pairs``: the best alignment as pair symbols a:b, ready to be counted as words."""
    from pyspark.sql import types as T

    shared = pairs.sparkSession.sparkContext.broadcast(_collected(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[f"{a}:{b}" for a, b in align(u or [], v or [], shared.value)[0]] for u, v in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True)]
            yield batch.append_column("pairs", pa.array(out, pa.list_(pa.string())))

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("pairs", T.ArrayType(T.StringType()))]))


def hamming(a: str = "decoded", b: str = "x"):
    """Places in which two arrays differ, with the difference of their lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda u, v: F.when(u.eqNullSafe(v), 0).otherwise(1)), F.lit(0), lambda s, d: s + d)
    return same


def sparser(model: DataFrame, power: float) -> DataFrame:
    """Probabilities raised to a power and normalised again: fewer edits carry the mass."""
    return m_step(model.select("ilabel", "olabel", F.pow("p", F.lit(power)).alias("n")))
