"""Edit distances and nearest lexicon entries."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(a: str, b: str, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, bound: float | None = None) -> float | None:
    """Least cost of edits that make b of a; None if it is above the bound."""
    row = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [i * delete]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + delete, row[j - 1] + insert, last[j - 1] + (0 if x == y else substitute)))
        if bound is not None and min(row) > bound:
            return None
    return None if bound is not None and row[-1] > bound else row[-1]


#: Cells of the tables that a batch of pairs is worked out on at once.
CELLS = 1 << 21


def _codes(texts: list[str], wide: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), wide), pad, dtype=np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def distances(a: list[str | None], b: list[str | None], insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, bound: float | None = None) -> list[float | None]:
    """``distance`` of many pairs at once, by anti-diagonals.

    A cell (i, j) of a pair's table depends on the two diagonals before its own alone, so a
    whole diagonal of all pairs is one step of arithmetic. With a bound only the band of
    cells is worked out that can be reached within it. Pairs are taken by length, some
    million cells at a time; a pair longer than that is taken alone.
    """
    out: list[float | None] = [None] * len(a)
    there = sorted((len(x) + len(y), i) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None)
    at = 0
    while at < len(there):
        end = at + 1
        while end < len(there) and (end + 1 - at) * (there[end][0] + 1) <= CELLS:
            end += 1
        rows = [i for _, i in there[at:end]]
        for i, d in zip(rows, _diagonals([a[i] for i in rows], [b[i] for i in rows], insert, delete, substitute, bound), strict=True):
            out[i] = None if bound is not None and d > bound else float(d)
        at = end
    return out


def _diagonals(a: list[str], b: list[str], insert: float, delete: float, substitute: float, bound: float | None) -> np.ndarray:
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wa, wb = int(la.max()), int(lb.max())
    x, y = _codes(a, wa, -1), _codes(b, wb, -2)
    found = np.full(len(a), np.inf)
    last = before = np.full((len(a), wa + 1), np.inf)
    for k in range(wa + wb + 1):
        low, high = max(0, k - wb), min(k, wa)
        if bound is not None and insert > 0 and (k - bound / insert) / 2 > low:
            low = ceil((k - bound / insert) / 2)
        if bound is not None and delete > 0 and (k + bound / delete) / 2 < high:
            high = floor((k + bound / delete) / 2)
        now = np.full((len(a), wa + 1), np.inf)
        if low <= high:
            i = np.arange(low, high + 1)
            cell = np.where((k - i > 0)[None, :], last[:, i] + insert, np.inf)
            up = i[i > 0]
            cell[:, i > 0] = np.minimum(cell[:, i > 0], last[:, up - 1] + delete)
            both = i[(i > 0) & (k - i > 0)]
            if len(both):
                change = np.where(x[:, both - 1] == y[:, k - both - 1], 0.0, substitute)
                place = (i > 0) & (k - i > 0)
                cell[:, place] = np.minimum(cell[:, place], before[:, both - 1] + change)
            if k == 0:
                cell[:] = 0.0
            now[:, low : high + 1] = cell
        done = np.flatnonzero(la + lb == k)
        found[done] = now[done, la[done]]
        before, last = last, now
    return found


def with_distance(df: DataFrame, a: str, b: str, out: str = "distance", insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, bound: float | None = None) -> DataFrame:
    """Unit costs stay in the JVM; other costs are worked out for a whole Arrow batch at once."""
    if insert == delete == substitute == 1.0 and bound is None:
        return df.withColumn(out, F.levenshtein(a, b).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = distances(batch.column(a).to_pylist(), batch.column(b).to_pylist(), insert, delete, substitute, bound)
            yield batch.append_column(out, pa.array(values, pa.float64()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def closest(queries: DataFrame, lexicon: DataFrame, query: str = "query", entry: str = "entry", bound: int = 2) -> DataFrame:
    """(query, entry, distance): the nearest entries within the bound, all ties.

    Blocking by pieces: strings within ``bound`` edits share one of bound + 1 pieces, moved
    by at most ``bound`` places, so candidates come from an equi-join on pieces, not from all pairs.
    """
    q = queries.select(query).where(F.col(query).isNotNull()).distinct()
    e = lexicon.select(entry).where(F.col(entry).isNotNull()).distinct()
    k = bound + 1
    n = F.length(entry)
    pieces = F.array(*(F.struct(F.lit(i).alias("piece"), n.alias("n"), F.expr(f"substring({entry}, cast(floor(length({entry}) * {i} / {k}) as int) + 1, cast(floor(length({entry}) * {i + 1} / {k}) as int) - cast(floor(length({entry}) * {i} / {k}) as int))").alias("text")) for i in range(k)))
    left = e.select(entry, F.explode(pieces).alias("x")).select(entry, "x.*")
    sizes = F.sequence(F.greatest(F.length(query) - bound, F.lit(0)), F.length(query) + bound)
    wide = q.select(query, F.explode(sizes).alias("n")).select(query, "n", F.explode(F.sequence(F.lit(0), F.lit(bound))).alias("piece"))
    at, end = F.floor(F.col("n") * F.col("piece") / k).cast("int"), F.floor(F.col("n") * (F.col("piece") + 1) / k).cast("int")
    wide = wide.select(query, "n", "piece", at.alias("at"), (end - at).alias("size"), F.explode(F.sequence(F.greatest(at - bound, F.lit(0)), at + bound)).alias("from"))
    right = wide.select(query, "n", "piece", F.expr(f"substring({query}, from + 1, size)").alias("text")).distinct()
    pairs = right.join(left, ["piece", "n", "text"]).select(query, entry).distinct()
    scored = pairs.withColumn("distance", F.levenshtein(query, entry)).where(F.col("distance") <= bound)
    return scored.withColumn("r", F.rank().over(Window.partitionBy(query).orderBy("distance"))).where("r = 1").drop("r")
