"""Stochastic automata with failure arcs.

An automaton is small and driver-side here; n-gram models of any size stay tables, for
which the table functions at the end do the same by joins. A failure arc is taken only by
labels that its state lacks. Weights are probabilities.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import FLOAT_EPS, NORM_EPS
from ..tables import discard, kept, stored
from .counting import suffix
from .smoothing import Model, backoffs

REENTRY = 0.999999
MOST_ROUNDS = 100
FINAL = ""  # the label of ending


@dataclass
class FailureAutomaton:
    """arcs[s][label] = (probability, next state); phi[s] = (weight, state); ends in final[s]."""

    start: int
    arcs: list[dict[str, tuple[float, int]]]
    final: list[float]
    phi: list[tuple[float, int] | None]

    def labels(self, s: int) -> dict[str, float]:
        return {a: p for a, (p, _) in self.arcs[s].items()} | ({FINAL: self.final[s]} if self.final[s] else {})


def phi_order(f: FailureAutomaton) -> list[int]:
    """How many failure arcs can follow each other from each state; a cycle of them is an error."""
    depth: dict[int, int] = {}

    def of(s: int, above: tuple[int, ...] = ()) -> int:
        if s in above:
            raise ValueError("a cycle of failure arcs")
        if s not in depth:
            depth[s] = 0 if f.phi[s] is None else 1 + of(f.phi[s][1], (*above, s))
        return depth[s]

    return [of(s) for s in range(len(f.arcs))]


def phi_top_order(f: FailureAutomaton) -> list[int]:
    order = phi_order(f)
    return sorted(range(len(order)), key=lambda s: (order[s], s))


def step(f: FailureAutomaton, s: int, label: str) -> tuple[float, int | None]:
    """Probability and next state of a label through failures; 0 if there is none."""
    p = 1.0
    while True:
        if label == FINAL and f.final[s]:
            return p * f.final[s], None
        if label in f.arcs[s]:
            q, d = f.arcs[s][label]
            return p * q, d
        if f.phi[s] is None:
            return 0.0, None
        w, s = f.phi[s]
        p *= w


def reached(f: FailureAutomaton, s: int) -> dict[str, float]:
    """The whole next-label distribution of a state."""
    out, p = {}, 1.0
    while True:
        for a, q in f.labels(s).items():
            out.setdefault(a, p * q)
        if f.phi[s] is None:
            return out
        w, s = f.phi[s]
        p *= w


def state_sums(f: FailureAutomaton) -> list[float]:
    return [sum(reached(f, s).values()) for s in range(len(f.arcs))]


def is_normalized(f: FailureAutomaton, delta: float = NORM_EPS) -> bool:
    return all(abs(x - 1) <= delta for x in state_sums(f))


def is_canonical(f: FailureAutomaton) -> bool:
    """No cycles of failures, and every state sums to 1."""
    try:
        phi_order(f)
    except ValueError:
        return False
    return is_normalized(f)


def is_backoff_complete(f: FailureAutomaton) -> bool:
    """Whether every label of a state with a failure arc can be read below it."""
    return all(f.phi[s] is None or all(step(f, f.phi[s][1], a)[0] > 0 for a in f.labels(s)) for s in range(len(f.arcs)))


def sum_backoff(f: FailureAutomaton) -> list[tuple[float, float]]:
    """For each state the sum of its own probabilities and of the same labels below."""
    return [(sum(f.labels(s).values()), sum(step(f, f.phi[s][1], a)[0] for a in f.labels(s)) if f.phi[s] else 0.0) for s in range(len(f.arcs))]


def diff_backoff(f: FailureAutomaton, s: int) -> dict[str, float]:
    return {a: p - (f.phi[s][0] * step(f, f.phi[s][1], a)[0] if f.phi[s] else 0.0) for a, p in f.labels(s).items()}


def _copy(f: FailureAutomaton) -> FailureAutomaton:
    return FailureAutomaton(f.start, [dict(x) for x in f.arcs], list(f.final), list(f.phi))


def phi_normalized(f: FailureAutomaton) -> FailureAutomaton:
    """Failure weights such that every state sums to 1; arcs stay."""
    g = _copy(f)
    for s in phi_top_order(f):
        if g.phi[s] is not None:
            own = sum(g.labels(s).values())
            below = sum(step(g, g.phi[s][1], a)[0] for a in g.labels(s))
            g.phi[s] = (max(0.0, 1 - own) / (1 - below) if below < 1 else math.exp(-99.0), g.phi[s][1])
    return g


def locally_normalized(f: FailureAutomaton) -> FailureAutomaton:
    """Arcs and failure arc of each state over their sum."""
    g = _copy(f)
    for s in range(len(f.arcs)):
        total = sum(f.labels(s).values()) + (f.phi[s][0] if f.phi[s] else 0.0)
        if total:
            g.arcs[s] = {a: (p / total, d) for a, (p, d) in f.arcs[s].items()}
            g.final[s] = f.final[s] / total
            g.phi[s] = (f.phi[s][0] / total, f.phi[s][1]) if f.phi[s] else None
    return g


def shortest_distance(f: FailureAutomaton, rounds: int = 10_000, delta: float = 1e-12) -> list[float]:
    """Total probability of the paths from each state to an end, failures included: a fixed point over the real numbers."""
    value = [0.0] * len(f.arcs)
    for _ in range(rounds):
        fresh = []
        for s in range(len(f.arcs)):
            total = 0.0
            for a in reached(f, s):
                p, d = step(f, s, a)
                total += p * (1.0 if a == FINAL else value[d])
            fresh.append(total)
        if max((abs(a - b) for a, b in zip(value, fresh, strict=True)), default=0.0) < delta:
            return fresh
        value = fresh
    return value


def globally_normalized(f: FailureAutomaton) -> FailureAutomaton:
    """Each state conditioned on ending: arcs times the mass beyond them, over the state's own."""
    mass = shortest_distance(f)
    g = FailureAutomaton(f.start, [], [], [None] * len(f.arcs))
    for s in range(len(f.arcs)):
        row, end = {}, 0.0
        for a in reached(f, s):
            p, d = step(f, s, a)
            if a == FINAL:
                end = p / mass[s] if mass[s] else 0.0
            else:
                row[a] = (p * mass[d] / mass[s] if mass[s] else 0.0, d)
        g.arcs.append(row)
        g.final.append(end)
    return g


def without_phi(f: FailureAutomaton) -> FailureAutomaton:
    """Failure arcs replaced by what can be read through them."""
    g = FailureAutomaton(f.start, [], [], [None] * len(f.arcs))
    for s in range(len(f.arcs)):
        ways = {a: step(f, s, a) for a in reached(f, s)}
        g.arcs.append({a: (p, d) for a, (p, d) in ways.items() if a != FINAL})
        g.final.append(ways.get(FINAL, (0.0, None))[0])
    return g


def intersected(a: FailureAutomaton, b: FailureAutomaton) -> FailureAutomaton:
    """Product of two automata, failures matched on both sides."""
    number, queue, out = {(a.start, b.start): 0}, [(a.start, b.start)], FailureAutomaton(0, [], [], [])
    while queue:
        s, t = queue.pop(0)
        row = {}
        for label in reached(a, s).keys() & reached(b, t).keys():
            (p, d), (q, e) = step(a, s, label), step(b, t, label)
            if label == FINAL:
                continue
            if (d, e) not in number:
                number[d, e] = len(number)
                queue.append((d, e))
            row[label] = (p * q, number[d, e])
        out.arcs.append(row)
        out.final.append(step(a, s, FINAL)[0] * step(b, t, FINAL)[0])
        out.phi.append(None)
    return out


def stationary(f: FailureAutomaton, delta: float = 1e-9) -> list[float]:
    """Long-run share of each state when ended strings begin anew (almost always)."""
    n = len(f.arcs)
    x = [1.0 / n] * n
    for _ in range(MOST_ROUNDS):
        y = [0.0] * n
        for s in range(n):
            for a in reached(f, s):
                p, d = step(f, s, a)
                y[f.start if d is None else d] += x[s] * p * (REENTRY if d is None else 1.0)
        total = sum(y) or 1.0
        y = [v / total for v in y]
        if max(abs(u - v) for u, v in zip(x, y, strict=True)) < delta:
            return y
        x = y
    return x


def visits(source: FailureAutomaton, topology: FailureAutomaton, rounds: int = 1000, delta: float = 1e-12) -> list[dict[str, float]]:
    """Expected number of times each arc of the topology is read by strings of the source; failures pass counts down."""
    pairs = {(source.start, topology.start): 1.0}
    counts: list[dict[str, float]] = [defaultdict(float) for _ in topology.arcs]
    for _ in range(rounds):
        fresh: dict[tuple[int, int], float] = defaultdict(float)
        for (s, t), m in pairs.items():
            for a in reached(source, s):
                p, d = step(source, s, a)
                at = t
                while at is not None and a not in topology.labels(at) and topology.phi[at] is not None:
                    counts[at]["<phi>"] += m * p
                    at = topology.phi[at][1]
                counts[at][a] += m * p
                if a != FINAL and a in topology.arcs[at]:
                    fresh[d, topology.arcs[at][a][1]] += m * p
        pairs = {k: v for k, v in fresh.items() if v > delta}
        if not pairs:
            break
    return [dict(c) for c in counts]


def count_normalized(topology: FailureAutomaton, counts: list[dict[str, float]], method: str = "kl_min", rounds: int = 200) -> FailureAutomaton:
    """Probabilities from counts. summed: counts over their sum. kl_min: of all normalised ones the nearest to the counts.

    The nearest one solves, for each state with failures, a fixed point in how the mass is
    split between its own arcs and what it passes on.
    """
    g = _copy(topology)
    for s in phi_top_order(topology):
        c = counts[s]
        own = sum(c.get(a, 0.0) for a in topology.labels(s))
        down = c.get("<phi>", 0.0)
        total = own + down
        if not total:
            continue
        share = own / total
        if topology.phi[s] is None:
            share = 1.0
        elif method == "kl_min_approximated":
            share = min(share, 1 - 1e-9)
        scale = share / own if own else 0.0
        g.arcs[s] = {a: (c.get(a, 0.0) * scale, d) for a, (_, d) in topology.arcs[s].items()}
        g.final[s] = c.get(FINAL, 0.0) * scale if topology.final[s] else 0.0
    return phi_normalized(g)


def approximated(source: FailureAutomaton, topology: FailureAutomaton, method: str = "kl_min") -> FailureAutomaton:
    """The automaton of a topology that is nearest to a source."""
    return count_normalized(topology, visits(source, topology), method)


def ngram_topology(sequences: list[list[str]], order: int) -> FailureAutomaton:
    """States for all histories below the order, failure arcs to their suffixes."""
    grams = {tuple(x[i : i + n]) for w in sequences for x in [["<s>", *w, FINAL]] for n in range(1, order + 1) for i in range(len(x) - n + 1)}
    hists = sorted({g[:-1] for g in grams if g[-1] != "<s>"} | {()}, key=lambda h: (len(h), h))
    number = {h: k for k, h in enumerate(hists)}
    f = FailureAutomaton(number.get(("<s>",) if order > 1 else (), 0), [{} for _ in hists], [0.0] * len(hists), [None] * len(hists))
    for g in grams:
        h, a = g[:-1], g[-1]
        if a == "<s>" or h not in number:
            continue
        if a == FINAL:
            f.final[number[h]] = 1.0
        else:
            to = g[max(0, len(g) - order + 1) :] if order > 1 else ()
            while to not in number:
                to = to[1:]
            f.arcs[number[h]][a] = (1.0, number[to])
    for h, k in number.items():
        if h:
            to = h[1:]
            while to not in number:
                to = to[1:]
            f.phi[k] = (1.0, number[to])
    return f


def ngram_approximated(source: FailureAutomaton, sequences: list[list[str]], order: int) -> FailureAutomaton:
    return approximated(source, ngram_topology(sequences, order))


def perplexity(p: FailureAutomaton, q: FailureAutomaton) -> float:
    """exp of the expected -ln q for each label over strings of p."""
    bits = size = 0.0
    pairs = {(p.start, q.start): 1.0}
    for _ in range(10_000):
        fresh: dict[tuple[int, int], float] = defaultdict(float)
        for (s, t), m in pairs.items():
            for a in reached(p, s):
                x, d = step(p, s, a)
                y, e = step(q, t, a)
                if not x:
                    continue
                if not y:
                    return math.inf
                bits -= m * x * math.log(y)
                size += m * x
                if a != FINAL:
                    fresh[d, e] += m * x
        pairs = {k: v for k, v in fresh.items() if v > 1e-15}
        if not pairs:
            break
    return math.exp(bits / size) if size else 1.0


def trimmed(f: FailureAutomaton, policy: str = "connect", threshold: float = 0.0) -> FailureAutomaton:
    """connect: states on no path go. phi: arcs that failures never leave reachable go too. weight: arcs up to a probability go; sum_weight: the smallest arcs of a state go while their sum is up to it."""
    g = _copy(f)
    for s in range(len(f.arcs)):
        if policy == "weight":
            g.arcs[s] = {a: x for a, x in f.arcs[s].items() if x[0] > threshold}
        elif policy == "sum_weight":
            total, kept = 0.0, dict(f.arcs[s])
            for a, (p, _) in sorted(f.arcs[s].items(), key=lambda x: (x[1][0], x[0])):
                total += p
                if total > threshold:
                    break
                del kept[a]
            g.arcs[s] = kept
    ahead, queue = {g.start}, [(g.start, frozenset())]
    seen = set(queue)
    while queue:
        s, barred = queue.pop()
        ahead.add(s)
        ways = [(d, frozenset()) for a, (p, d) in g.arcs[s].items() if policy != "phi" or a not in barred]
        if g.phi[s] is not None and g.phi[s][0] > 0:
            ways.append((g.phi[s][1], (barred | g.arcs[s].keys()) if policy == "phi" else frozenset()))
        for w in ways:
            if w not in seen:
                seen.add(w)
                queue.append(w)
    back = {s for s in range(len(g.arcs)) if g.final[s] > 0}
    while True:
        more = {s for s in range(len(g.arcs)) if s not in back and (any(d in back for _, d in g.arcs[s].values()) or (g.phi[s] is not None and g.phi[s][1] in back))}
        if not more:
            break
        back |= more
    good = sorted((ahead & back) | {g.start})
    number = {s: k for k, s in enumerate(good)}
    return FailureAutomaton(number[g.start], [{a: (p, number[d]) for a, (p, d) in g.arcs[s].items() if d in number} for s in good], [g.final[s] for s in good], [(g.phi[s][0], number[g.phi[s][1]]) if g.phi[s] and g.phi[s][1] in number else None for s in good])


def equal(a: FailureAutomaton, b: FailureAutomaton, ignore_phi: bool = True, delta: float = 1e-6) -> bool:
    close = lambda x, y: abs(x - y) <= delta
    return a.start == b.start and len(a.arcs) == len(b.arcs) and all(x.keys() == y.keys() and all(x[k][1] == y[k][1] and close(x[k][0], y[k][0]) for k in x) for x, y in zip(a.arcs, b.arcs, strict=True)) and all(map(close, a.final, b.final)) and all((x is None) == (y is None) and (x is None or (x[1] == y[1] and (ignore_phi or close(x[0], y[0])))) for x, y in zip(a.phi, b.phi, strict=True))


def isomorphic(a: FailureAutomaton, b: FailureAutomaton) -> bool:
    """Equal up to the numbering of states."""

    def canonical(f: FailureAutomaton) -> FailureAutomaton:
        order, queue = [f.start], [f.start]
        while queue:
            s = queue.pop(0)
            for d in [f.arcs[s][x][1] for x in sorted(f.arcs[s])] + ([f.phi[s][1]] if f.phi[s] else []):
                if d not in order:
                    order.append(d)
                    queue.append(d)
        n = {s: k for k, s in enumerate(order)}
        return FailureAutomaton(0, [{x: (p, n[d]) for x, (p, d) in f.arcs[s].items()} for s in order], [f.final[s] for s in order], [(f.phi[s][0], n[f.phi[s][1]]) if f.phi[s] else None for s in order])

    return equal(canonical(a), canonical(b))


def random_strings(f: FailureAutomaton, n: int, seed: int = 0, most: int = 10_000) -> list[list[str]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        s, word = f.start, []
        while len(word) < most:
            ways = reached(f, s)
            a = rng.choices(list(ways), list(ways.values()))[0]
            if a == FINAL:
                break
            word.append(a)
            s = step(f, s, a)[1]
        out.append(word)
    return out


def state_weights(f: FailureAutomaton) -> list[float]:
    """The mass of paths through each state from the start."""
    x, total = [0.0] * len(f.arcs), [0.0] * len(f.arcs)
    x[f.start] = 1.0
    for _ in range(10_000):
        total = [a + b for a, b in zip(total, x, strict=True)]
        y = [0.0] * len(f.arcs)
        for s, m in enumerate(x):
            if m > 1e-15:
                for a in reached(f, s):
                    p, d = step(f, s, a)
                    if d is not None:
                        y[d] += m * p
        x = y
        if max(x, default=0.0) <= 1e-15:
            break
    return total


def info(f: FailureAutomaton) -> dict[str, object]:
    return {"states": len(f.arcs), "arcs": sum(map(len, f.arcs)), "phi_arcs": sum(p is not None for p in f.phi), "final_states": sum(x > 0 for x in f.final), "max_phi_order": max(phi_order(f), default=0), "canonical": is_canonical(f), "backoff_complete": is_backoff_complete(f)}


# n-gram models as tables.


def marginalised(model: Model, rounds: int = 10, delta: float = NORM_EPS) -> Model:
    """Lower-order probabilities under which the model has its own marginals, from the highest order down.

    For a state (a history) and a word: the mass that the states above it give the word by
    their own n-grams is taken off, and the rest is spread over the mass of those that back
    off for it. New probabilities change the backoffs of the states above, and those the
    spread: this is repeated until no backoff changes by ``delta`` (in its logarithm), at
    most ``rounds`` times for each order. Every round is written.
    """
    from .scoring import history_probability

    order = model.order
    if order < 2:
        return model
    raw = kept(history_probability(model).where("ph > 0"), "histories")
    above = raw.where("hist != ''").groupBy(suffix("hist").alias("hist")).agg(F.sum("ph").alias("more"))
    own = raw.join(above, "hist", "left").select("hist", F.greatest(F.col("ph") - F.coalesce("more", F.lit(0.0)), F.lit(1e-20)).alias("d"))
    total = own.agg(F.sum("d").alias("s"))
    states = kept(own.crossJoin(F.broadcast(total)).select("hist", (F.col("d") / F.col("s")).alias("d")), "states")
    length = F.when(F.col("hist") == "", 0).otherwise(F.size(F.split("hist", " ")))

    grams = {n: model.grams.where(F.col("ord") == n) for n in range(1, order + 1)}
    # Of the states of one length: d, the mass that ends there; all, with the states above; back, as far as it backs off to there.
    level = states.where(length == order - 1).select("hist", "d", F.col("d").alias("all"), F.col("d").alias("back"))
    arcs = grams[order].join(level.select("hist", "d"), "hist").select("hist", "word", "p", F.lit(0.0).alias("found"), F.col("d").alias("spread"))
    for n in range(order - 1, 0, -1):
        level, arcs = kept(level, "level"), kept(arcs, "arcs")
        alphas = model.backoffs.join(level.select("hist"), "hist", "left_semi")
        found = arcs.groupBy(suffix("hist").alias("hist"), "word").agg(F.sum(F.col("found") + F.col("p") * F.col("spread")).alias("found"))
        sums = level.groupBy(suffix("hist").alias("hist")).agg(F.sum("all").alias("higher"))
        base = states.where(length == n - 1).join(sums, "hist", "left").select("hist", "d", (F.col("d") + F.coalesce("higher", F.lit(0.0))).alias("all"))
        fixed = grams[n].select("hist", "word", "p").join(base, "hist").join(found, ["hist", "word"], "left")
        rest = F.col("p") * F.col("all") - F.coalesce("found", F.lit(0.0))
        fixed = kept(fixed.select("hist", "word", "p", "d", "all", F.coalesce("found", F.lit(0.0)).alias("found"), F.when(rest > 0, rest).otherwise(FLOAT_EPS).alias("rest")), "fixed")
        mass = kept(fixed.groupBy("hist").agg(F.sum("p").alias("mass")), "mass")
        for _ in range(max(1, rounds)):
            led = level.join(alphas, "hist").select("hist", (F.col("alpha") * F.col("back")).alias("m"))
            back = led.groupBy(suffix("hist").alias("hist")).agg(F.sum("m").alias("m"))
            barred = arcs.select("hist", "word").join(led, "hist").groupBy(suffix("hist").alias("hist"), "word").agg(F.sum("m").alias("barred"))
            spread = F.greatest(F.col("d") + F.coalesce("m", F.lit(0.0)) - F.coalesce("barred", F.lit(0.0)), F.lit(1e-20))
            made = fixed.join(back, "hist", "left").join(barred, ["hist", "word"], "left").select("hist", "word", "d", "all", "found", F.coalesce("m", F.lit(0.0)).alias("m"), spread.alias("spread"), (F.col("rest") / spread).alias("w"))
            made = kept(made, "weights")
            norm = made.groupBy("hist").agg(F.sum("w").alias("s")).join(mass, "hist").select("hist", (F.col("mass") / F.col("s")).alias("scale"))
            new = kept(made.join(norm, "hist").select("hist", "word", (F.col("w") * F.col("scale")).alias("p"), "d", "all", "found", "m", "spread"), "marginals")
            low = new.select(F.lit(n).alias("ord"), "hist", "word", "p")
            fresh = kept(backoffs(grams[n + 1].unionByName(low) if n == 1 else grams[n + 1].unionByName(low).unionByName(grams[1]), n + 1).join(level.select("hist"), "hist", "left_semi"), "backoffs")
            change = fresh.withColumnRenamed("alpha", "a2").join(alphas, "hist").agg(F.max(F.abs(F.log("a2") - F.log("alpha"))).alias("x")).first()["x"]
            alphas = fresh
            if change is None or change < delta:
                break
        grams[n] = low
        level = new.groupBy("hist").agg(F.first("d").alias("d"), F.first("all").alias("all"), (F.first("d") + F.first("m")).alias("back"))
        arcs = new.select("hist", "word", "p", "found", "spread")
    out = grams[1]
    for n in range(2, order + 1):
        out = out.unionByName(grams[n])
    return Model(out, backoffs(out, order), order)


def thresholded(model: Model, scores: DataFrame, theta: float, strict: bool = False) -> Model:
    """Pruning on each n-gram's own score, with no propagation; what survivors need stays."""
    from .shrinking import complete

    gone = scores.where(F.col("score") < theta if strict else F.col("score") <= theta).select("ord", "hist", "word")
    kept = model.grams.join(gone, ["ord", "hist", "word"], "left_anti")
    need = complete(kept, model.order)
    kept = model.grams.join(need, ["ord", "hist", "word"], "left_semi")
    return Model(kept, backoffs(kept, model.order), model.order)


def stationary_shares(edges: DataFrame, start: str, rounds: int = 256, at_once: int = 8, eps: float = 1e-11) -> DataFrame:
    """(state, share): the stationary distribution of a chain given as edges (src, dst, weight), as seen from a start state.

    Weights of a state are scaled to sum to 1. Each step stays with a chance of one half, which
    changes no stationary share but lets periodic chains settle. What moves is one row for each
    state that is reached, never a table of pairs of states; ``at_once`` steps are one job. It
    ends when no share changes by more than ``eps``, or after ``rounds`` steps.
    """
    spark = edges.sparkSession
    totals = kept(edges.groupBy("src").agg(F.sum("weight").alias("t")), "totals")
    moves = edges.join(totals, "src").groupBy("src", "dst").agg((F.sum(F.col("weight") / F.col("t")) / 2).alias("p"))
    stays = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().join(totals, "src", "left")
    stays = stays.select("src", F.col("src").alias("dst"), F.when(F.col("t").isNull(), 1.0).otherwise(0.5).alias("p"))  # a state without edges keeps what reaches it
    steps = kept(moves.unionByName(stays), "steps")
    now, path = stored(spark.createDataFrame([(start, 1.0)], "state string, share double"), "shares")
    for _ in range(-(-rounds // at_once)):
        after = now
        for _ in range(at_once):
            after = after.join(steps, F.col("state") == F.col("src")).groupBy(F.col("dst").alias("state")).agg(F.sum(F.col("share") * F.col("p")).alias("share"))
        both, last = stored(after.join(now.withColumnRenamed("share", "before"), "state", "left").select("state", "share", F.coalesce("before", F.lit(0.0)).alias("before")), "shares")
        discard(spark, path)
        now, path = both.select("state", "share"), last
        if both.where(F.abs(F.col("share") - F.col("before")) > eps).isEmpty():
            break
    return now
