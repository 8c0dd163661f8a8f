"""Lattices: expected n-gram counts, and models applied to them."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .fst import EMPTY, Fst, connect, explore, topological

BOS, EOS = "<s>", "</s>"


def _mass(f: Fst) -> tuple[list[float], list[float]]:
    """Forward and backward sums of exp(-cost) of an acyclic lattice."""
    order = topological(f)
    if order is None:
        raise ValueError("a lattice must be acyclic")
    ahead, back = [0.0] * len(f.arcs), [0.0] * len(f.arcs)
    ahead[f.start] = 1.0
    for s in order:
        for _, _, w, d in f.arcs[s]:
            ahead[d] += ahead[s] * math.exp(-w)
    for s in reversed(order):
        back[s] = (math.exp(-f.finals[s]) if s in f.finals else 0.0) + sum(math.exp(-w) * back[d] for _, _, w, d in f.arcs[s])
    return ahead, back


def expected_counts(f: Fst, words: dict[int, str], order: int, backoff_epsilon: bool = False) -> dict[tuple[str, ...], float]:
    """Expected count of each n-gram over the lattice's paths, weighed by exp(-cost).

    States are split by their last words; empty arcs keep the history, or, with
    ``backoff_epsilon``, drop its first word.
    """
    f = connect(f)
    if f.start < 0:
        return {}
    _, back = _mass(f)
    counts: dict[tuple[str, ...], float] = defaultdict(float)
    held: dict[int, dict[tuple[str, ...], float]] = defaultdict(lambda: defaultdict(float))
    held[f.start][(BOS,)[: order - 1]] = 1.0
    for s in topological(f):
        for hist, p in list(held[s].items()):
            for i, _, w, d in f.arcs[s]:
                q = p * math.exp(-w)
                if i == 0:
                    held[d][hist[1:] if backoff_epsilon else hist] += q
                    continue
                gram = (*hist, words[i])
                for k in range(len(gram)):
                    counts[gram[k:]] += q * back[d]
                held[d][gram[max(0, len(gram) - order + 1) :] if order > 1 else ()] += q
            if s in f.finals:
                q = p * math.exp(-f.finals[s])
                gram = (*hist, EOS)
                for k in range(len(gram)):
                    counts[gram[k:]] += q
    return dict(counts)


def count_lattices(df: DataFrame, order: int = 3, column: str = "lattice") -> DataFrame:
    """(ord, hist, word, c) from a column of arcs array<struct<src,word,weight,dst>>, state 0 the start and -1 the end.

    Each lattice is counted in its row; the rows are summed by a partial aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, ...], float] = defaultdict(float)

        def flush() -> pa.RecordBatch:
            rows = [(len(g), " ".join(g[:-1]), g[-1], c) for g, c in total.items()]
            total.clear()
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["ord", "hist", "word", "c"])

        for batch in batches:
            for arcs in batch.column(column).to_pylist():
                for g, c in expected_counts(*lattice(arcs or []), order).items():
                    total[g] += c
                if len(total) > 200_000:
                    yield flush()
        yield flush()

    return df.select(column).mapInArrow(run, "ord int, hist string, word string, c double").groupBy("ord", "hist", "word").sum("c").withColumnRenamed("sum(c)", "c")


def lattice(arcs: list[dict]) -> tuple[Fst, dict[int, str]]:
    """A lattice from rows of arcs, and its words by label."""
    labels: dict[str, int] = {}
    top = max([0, *(max(a["src"], a["dst"]) for a in arcs)])
    rows: list[list] = [[] for _ in range(top + 2)]
    for a in arcs:
        label = labels.setdefault(a["word"], len(labels) + 1) if a["word"] else 0
        rows[a["src"]].append((label, label, a["weight"], a["dst"] if a["dst"] >= 0 else top + 1))
    return (Fst(0, tuple(map(tuple, rows)), {top + 1: 0.0}), {v: k for k, v in labels.items()}) if arcs else (EMPTY, {})


class Scorer:
    """A small backoff model for lattices: log costs of words after histories."""

    def __init__(self, grams: dict[tuple[str, ...], float], backoffs: dict[tuple[str, ...], float], order: int, unknown: float = 99.0):
        self.grams, self.backoffs, self.order, self.unknown = grams, backoffs, order, unknown

    @staticmethod
    def collect(model, most: int = 2_000_000) -> Scorer:
        """From a model of a checked size."""
        if (n := model.grams.count()) > most:
            raise ValueError(f"{n} n-grams are too many to send to all executors")
        grams = {(*filter(None, r["hist"].split(" ")), r["word"]): -math.log(r["p"]) for r in model.grams.collect() if r["p"] > 0}
        backoffs = {tuple(r["hist"].split(" ")): -math.log(r["alpha"]) for r in model.backoffs.collect() if r["alpha"]}
        return Scorer(grams, backoffs, model.order)

    def cost(self, hist: tuple[str, ...], word: str) -> tuple[float, int, tuple[str, ...]]:
        """Cost of a word, the number of backoffs, and the history that follows."""
        total, steps = 0.0, 0
        h = hist
        while True:
            if (*h, word) in self.grams:
                full = (*h, word)
                return total + self.grams[full], steps, full[max(0, len(full) - self.order + 1) :] if self.order > 1 else ()
            if not h:
                return total + self.unknown, steps, ()
            total, steps, h = total + self.backoffs.get(h, 0.0), steps + 1, h[1:]


def apply_model(f: Fst, words: dict[int, str], scorer: Scorer, method: str = "phi") -> Fst:
    """The lattice with the model's costs added to its own.

    phi: exact failure. lexicographic: as exact, of equal strings the one with the fewest
    backoffs. epsilon: backoffs taken freely, so a string costs the least of its ways.
    """

    def ways(hist, word):
        if method != "epsilon":
            yield scorer.cost(hist, word)
            return
        total, h = 0.0, hist
        while True:
            if (*h, word) in scorer.grams:
                full = (*h, word)
                yield total + scorer.grams[full], 0, full[max(0, len(full) - scorer.order + 1) :] if scorer.order > 1 else ()
            if not h:
                return
            total, h = total + scorer.backoffs.get(h, 0.0), h[1:]

    def expand(state):
        s, hist = state
        for i, o, w, d in f.arcs[s]:
            if not i:
                yield i, o, w, (d, hist)
                continue
            for c, _, then in ways(hist, words[i]):
                yield i, o, w + c, (d, then)

    def final(state):
        s, hist = state
        return f.finals[s] + min(c for c, *_ in ways(hist, EOS)) if s in f.finals else None

    return explore((f.start, (BOS,) if scorer.order > 1 else ()), expand, final) if f.start >= 0 else f
