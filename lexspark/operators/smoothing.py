"""Smoothing of n-gram counts to a backoff model, order by order.

A model is two tables: grams (ord, hist, word, p) and backoffs (hist, alpha). Each order
needs one join to the one below on (suffix of the history, word); no loop is longer than
the order. The one total of the unigrams is sent to all; those of longer histories are sums
over windows, which spill. Each order is written once, with what it has one history
shorter, so that backoffs and scores need no such join again, and read by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semiring import FLOAT_EPS, INF_BACKOFF
from ..tables import discard, kept, stored
from .counting import count_of_counts, suffix

NEVER = 2.718281828459045**-INF_BACKOFF


@dataclass
class Model:
    grams: DataFrame  # ord, hist, word, p
    backoffs: DataFrame  # hist, alpha
    order: int
    notes: dict[str, object] = field(default_factory=dict)
    pairs: DataFrame | None = None  # ord, hist, word, p and q, the same one history shorter, of the n-grams of order 2 or more that have both, where they are at hand


def backoffs(grams: DataFrame, order: int) -> DataFrame:
    """(hist, alpha): mass left by a history over the mass that its words leave below it."""
    low = grams.select((F.col("ord") + 1).alias("ord"), F.col("hist").alias("low"), "word", F.col("p").alias("q"))
    high = grams.where("ord > 1").withColumn("low", suffix("hist"))
    return _backoffs(high.join(low, ["ord", "low", "word"]), grams)


def _backoffs(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    sums = pairs.groupBy("hist").agg(F.sum("p").alias("own"), F.sum("q").alias("below"), F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(vocabulary_size(grams))).select("hist", alpha(1 - F.col("own"), 1 - F.col("below")).alias("alpha"))


def vocabulary_size(grams: DataFrame) -> DataFrame:
    """One row, v."""
    return grams.where("ord = 1").agg(F.count("*").alias("v"))


def alpha(left: Column, below: Column) -> Column:
    """The backoff of a history with n words of v, from the mass that it leaves and that its words leave below it."""
    return F.when((F.col("n") >= F.col("v")) | (below <= 0) | (left <= 0), F.lit(NEVER)).otherwise(left / below)


def _mixed(counts: DataFrame, discounted: Column, mass: Callable[[Column, Column], Column], order: int, interpolate: bool, eps: float = 1.0) -> DataFrame:
    """(ord, hist, word, p, q): discounted counts over the total mass of their history, with or without the order below, and that."""
    made = counts.withColumn("d", F.greatest(discounted, F.lit(0.0)))
    one = made.where("ord = 1").select("ord", "hist", "word", "c")
    total = one.agg(F.sum("c").alias("n"))
    below = kept(one.crossJoin(F.broadcast(total)).select("ord", "hist", "word", (F.col("c") / F.col("n")).alias("p"), F.lit(None).cast("double").alias("q")), "order")
    done = below
    own = Window.partitionBy("hist")
    for n in range(2, order + 1):
        sums = made.where(F.col("ord") == n).select("ord", "hist", "word", "d", F.sum("c").over(own).alias("n"), F.sum("d").over(own).alias("h"), F.count("*").over(own).alias("types"))
        t0 = mass(F.col("n"), F.col("types"))
        near = F.abs(F.log(t0) - F.log(F.col("h"))) < FLOAT_EPS
        sums = sums.select("ord", "hist", "word", "d", "h", F.when(near, F.col("h") + eps).otherwise(t0).alias("t"))
        rows = sums.select("ord", "hist", "word", (F.col("d") / F.col("t")).alias("p"), ((F.col("t") - F.col("h")) / F.col("t")).alias("rest"))
        q = F.lit(None).cast("double")
        if interpolate:
            lower = below.select(F.col("hist").alias("low"), "word", F.col("p").alias("q"))
            rows = rows.join(lower.drop("low"), "word", "left") if n == 2 else rows.withColumn("low", suffix("hist")).join(lower, ["low", "word"], "left")
            rows, q = rows.withColumn("p", F.col("p") + F.col("rest") * F.coalesce("q", F.lit(0.0))), F.col("q")
        below = kept(rows.select("ord", "hist", "word", "p", q.alias("q")), "order")
        done = done.unionByName(below)
    return done


def _model(grams: DataFrame, order: int, **notes) -> Model:
    return Model(grams, backoffs(grams, order), order, notes)


def _paired(rows: DataFrame, order: int, interpolate: bool, **notes) -> Model:
    """A model from what ``_mixed`` gives."""
    grams = rows.select("ord", "hist", "word", "p")
    if not interpolate:
        return _model(grams, order, **notes)
    pairs = rows.where("ord > 1 and q is not null")
    return Model(grams, _backoffs(pairs, grams), order, notes, pairs)


def witten_bell(counts: DataFrame, order: int, k: float = 1.0, interpolate: bool = True) -> Model:
    return _paired(_mixed(counts, F.col("c").cast("double"), lambda n, types: n + k * types, order, interpolate), order, interpolate)


def unsmoothed(counts: DataFrame, order: int) -> Model:
    """Relative frequencies; no mass is left for backoff."""
    totals = kept(counts.groupBy("ord", "hist").agg(F.sum("c").alias("n")), "totals")
    one = counts.where("ord = 1").crossJoin(F.broadcast(totals.where("ord = 1").select("n")))
    high = counts.where("ord > 1").join(totals.where("ord > 1"), ["ord", "hist"])
    share = (F.col("c") / F.col("n")).alias("p")
    return _model(kept(one.select("ord", "hist", "word", share).unionByName(high.select("ord", "hist", "word", share)), "order"), order)


def presmoothed(counts: DataFrame, order: int) -> Model:
    """Counts over the count of their history as an n-gram, for counts that already leave mass."""
    own = counts.where("ord > 1").select(*counts.columns)
    total = counts.select((F.col("ord") + 1).alias("ord"), F.when(F.col("hist") == "", F.col("word")).otherwise(F.concat_ws(" ", "hist", "word")).alias("hist"), F.col("c").alias("n"))
    begun = counts.where("ord > 1").groupBy("ord", "hist").agg(F.sum("c").alias("sum"))
    high = own.join(total, ["ord", "hist"], "left").join(begun, ["ord", "hist"]).select("ord", "hist", "word", (F.col("c") / F.greatest(F.coalesce("n", "sum"), F.col("sum"))).alias("p"))
    sum_of = counts.where("ord = 1").agg(F.sum("c").alias("n"))
    one = counts.where("ord = 1").crossJoin(F.broadcast(sum_of)).select("ord", "hist", "word", (F.col("c") / F.col("n")).alias("p"))
    return _model(kept(one.unionByName(high), "order"), order)


def _numbers(counts: DataFrame, given: DataFrame | None) -> dict[tuple[int, int], float]:
    """Counts of counts by order: those given, where the counts are a part of all."""
    found = count_of_counts(counts, 32) if given is None else given
    return {(r["ord"], r["r"]): float(r["n"]) for r in found.collect()}  # at most 33 rows an order


def absolute_discounts(counts: DataFrame, order: int, discount: float | None = None, bins: int = 1, given: DataFrame | None = None) -> dict[int, list[float]]:
    """The discount of each order for counts 1 to bins; the last holds for all larger counts. given: counts of counts."""
    found = _numbers(counts, given)
    out = {}
    for n in range(1, order + 1):
        if discount is not None:
            out[n] = [discount] * bins
            continue
        k = next((k for k in range(1, 32) if found.get((n, k)) and found.get((n, k + 1))), None)
        if k is None:
            out[n] = [0.6] * bins
            continue
        a, b = k * found[n, k], (k + 1) * found[n, k + 1]
        y = a / (a + b)
        row = []
        for r in range(1, bins + 1):
            low, high = found.get((n, r), 0), found.get((n, r + 1), 0)
            d = r - (r + 1) * y * high / low if low and high else 0.6
            row.append(d if d > 0 else 0.001)
        out[n] = row
    return out


#: Discounts of counts 1, 2 and 3 or more where the data gives none, and the ratio without counts of one and two.
PLAIN_DISCOUNTS = (0.5, 0.75, 0.85)
PLAIN_RATIO = 0.75


def plain_discounts(counts: DataFrame, order: int, bins: int = 1, given: DataFrame | None = None) -> dict[int, list[float]]:
    """Discounts from the numbers of counts of one and two alone, with fixed ones where a count doesn't occur or they fall outside (0, count)."""
    found = _numbers(counts, given)
    out = {}
    for n in range(1, order + 1):
        one, two = found.get((n, 1), 0.0), found.get((n, 2), 0.0)
        y = one / (one + 2 * two) if one + 2 * two else PLAIN_RATIO
        row = []
        for r in range(1, bins + 1):
            low, high = found.get((n, r), 0.0), found.get((n, r + 1), 0.0)
            d = r - (r + 1) * y * high / low if low else 0.0
            row.append(d if 0 < d < r else PLAIN_RATIO if bins == 1 else PLAIN_DISCOUNTS[min(r, 3) - 1])
        out[n] = row
    return out


def _by_order(table: dict[int, Column]) -> Column:
    out = F.lit(None)
    for n, value in table.items():
        out = F.when(F.col("ord") == n, value).otherwise(out)
    return out


def absolute(counts: DataFrame, order: int, discount: float | None = None, bins: int = 1, interpolate: bool = True, given: DataFrame | None = None, plain: bool = False) -> Model:
    """plain: discounts that aren't given come from ``plain_discounts``."""
    table = plain_discounts(counts, order, bins, given) if plain and discount is None else absolute_discounts(counts, order, discount, bins, given)
    r = F.least(F.greatest(F.floor(F.col("c") + 0.5), F.lit(1)), F.lit(bins)).cast("int")
    d = _by_order({n: F.element_at(F.array(*map(F.lit, row)), r) for n, row in table.items()})
    return _paired(_mixed(counts, F.col("c") - d, lambda n, types: n.cast("double"), order, interpolate), order, interpolate, discounts=table)


def continuation_counts(counts: DataFrame, order: int) -> DataFrame:
    """Below the highest order: what no longer n-gram accounts for, and the number of different words before."""
    out = counts.where(F.col("ord") == order).select("ord", "hist", "word", F.col("c").cast("double").alias("c"))
    low = counts.where((F.col("ord") < order))
    left = counts.where("ord > 1").select((F.col("ord") - 1).alias("ord"), suffix("hist").alias("hist"), "word", "c").groupBy("ord", "hist", "word").agg(F.sum("c").alias("more"), F.count("*").alias("before"))
    rest = F.col("c") - F.coalesce("more", F.lit(0))
    rest = F.when(rest < 0.001, F.lit(0.0)).otherwise(rest)
    made = low.join(left, ["ord", "hist", "word"], "left").select("ord", "hist", "word", (rest + F.coalesce("before", F.lit(0))).alias("c"))
    return out.unionByName(made)


def kneser_ney(counts: DataFrame, order: int, discount: float | None = None, bins: int = 1, interpolate: bool = True, plain: bool = False, spent: str | None = None) -> Model:
    """spent: the path of the counts, where they may be deleted once they have been read."""
    continued, path = stored(continuation_counts(counts, order), "continuations")
    if spent:
        discard(counts.sparkSession, spent)
    model = absolute(continued, order, discount, bins, interpolate, plain=plain)
    discard(counts.sparkSession, path)
    return model


def katz_discounts(counts: DataFrame, order: int, k: int = 5, given: DataFrame | None = None) -> dict[int, list[float]]:
    """d_r for r from 1 to k by Good-Turing, freed of what counts above k keep. given: counts of counts."""
    found = _numbers(counts, given)
    out = {}
    for n in range(1, order + 1):
        n1 = next((j for j in range(1, k + 1) if found.get((n, j))), None)
        row = []
        for r in range(1, k + 1):
            nr, up = found.get((n, r), 0.0), found.get((n, r + 1), 0.0)
            d = 0.999
            if nr and n1:
                rho = (k + 1) * found.get((n, k + 1), 0.0) / (n1 * found[n, n1])
                if rho < 1:
                    d = ((r + 1) * up / nr / r - rho) / (1 - rho)
            row.append(d if 0 < d < 1 else 0.999)
        out[n] = row
    return out


def katz(counts: DataFrame, order: int, k: int = 5, interpolate: bool = False, given: DataFrame | None = None) -> Model:
    table = katz_discounts(counts, order, k, given)
    r = F.floor(F.col("c") + 0.5)
    d = _by_order({n: F.when(r <= k, F.element_at(F.array(*map(F.lit, row)), F.least(F.greatest(r, F.lit(1)), F.lit(k)).cast("int"))).otherwise(F.lit(0.999)) for n, row in table.items()})
    return _paired(_mixed(counts, F.col("c") * d, lambda n, types: n.cast("double"), order, interpolate), order, interpolate, discounts=table)


def katz_fractional(histograms: DataFrame, order: int, discounts: dict[int, list[float]]) -> Model:
    """Expected discounted counts: sum over k of p(k) k d_k; always mixed with the order below. histograms: ord, hist, word, expected, p."""
    rows = _by_order({n: F.array(*map(F.lit, [0.0, *row])) for n, row in discounts.items()})
    made = histograms.withColumn("_d", rows)
    size = F.least(F.size("p"), F.size("_d")) - 1
    kept = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda s, i: s + F.element_at("p", i + 1) * i * F.element_at("_d", i + 1))
    seen = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda s, i: s + F.element_at("p", i + 1) * i)
    counts = made.select("ord", "hist", "word", F.col("expected").alias("c"), (kept + F.greatest(F.col("expected") - seen, F.lit(0.0)) * 0.999).alias("e"))
    return _paired(_mixed(counts, F.col("e"), lambda n, types: n, order, True), order, True)


def modified_kneser_ney(counts: DataFrame, order: int, bins: int = 3, plain: bool = False, spent: str | None = None) -> Model:
    """Three discounts an order, for counts 1, 2 and more."""
    return kneser_ney(counts, order, None, bins, plain=plain, spent=spent)


METHODS = {"witten_bell": witten_bell, "absolute": absolute, "katz": katz, "kneser_ney": kneser_ney, "modified_kneser_ney": modified_kneser_ney, "unsmoothed": unsmoothed, "presmoothed": presmoothed}


def make(counts: DataFrame, method: str, order: int, backoff: bool = False, interpolate: bool = False, **options) -> Model:
    if backoff and interpolate:
        raise ValueError("backoff and interpolate exclude each other")
    if method in ("witten_bell", "absolute", "katz", "kneser_ney") and (backoff or interpolate):
        options["interpolate"] = interpolate
    return METHODS[method](counts, order, **options)


def normalisation(model: Model) -> DataFrame:
    """(hist, total): the mass of each history with what it passes below; 1 if it is normalised."""
    low = model.grams.select((F.col("ord") + 1).alias("ord"), F.col("hist").alias("low"), "word", F.col("p").alias("q"))
    high = model.grams.where("ord > 1").withColumn("low", suffix("hist")).join(low, ["ord", "low", "word"], "left")
    sums = high.groupBy("hist").agg(F.sum("p").alias("own"), F.sum("q").alias("below")).join(model.backoffs, "hist", "left")
    total = sums.select("hist", (F.col("own") + F.coalesce("alpha", F.lit(0.0)) * (1 - F.col("below"))).alias("total"))
    return total.unionByName(model.grams.where("ord = 1").groupBy("hist").agg(F.sum("p").alias("total")))


def topology_faults(grams: DataFrame) -> DataFrame:
    """n-grams whose suffix, or whose history, is missing below them. Either kind is written by itself, so that their shuffles don't add up."""
    own = grams.where("ord > 1").select("ord", "hist", "word")
    below = grams.select((F.col("ord") + 1).alias("ord"), F.col("hist").alias("low"), "word")
    lost = kept(own.withColumn("low", suffix("hist")).join(below, ["ord", "low", "word"], "left_anti").select("ord", "hist", "word", F.lit("suffix").alias("fault")), "faults")
    whole = grams.select((F.col("ord") + 1).alias("ord"), F.when(F.col("hist") == "", F.col("word")).otherwise(F.concat_ws(" ", "hist", "word")).alias("hist"))
    missing = kept(own.where("hist != '<s>'").select("ord", "hist").distinct().join(whole, ["ord", "hist"], "left_anti"), "missing")
    begun = own.join(missing, ["ord", "hist"], "left_semi").select("ord", "hist", "word", F.lit("history").alias("fault"))
    return lost.unionByName(begun)
