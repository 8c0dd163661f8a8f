"""Merging of counts and models, contexts and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import kept
from .counting import GRAM, suffix
from .smoothing import Model, backoffs


def merge_counts(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha c1 + beta c2; what one lacks counts 0."""
    rows = a.select(*GRAM, (F.col("c") * alpha).alias("c")).unionByName(b.select(*GRAM, (F.col("c") * beta).alias("c")))
    return rows.groupBy(*GRAM).agg(F.sum("c").alias("c"))


@dataclass
class Joint:
    """Two models over the n-grams and histories of either."""

    grams: DataFrame  # ord, hist, word, p1, p2, in1, in2, and low1, low2: the same one history shorter
    alphas: DataFrame  # hist, a1, a2: 1 where a model hasn't the history


def joint(a: Model, b: Model) -> Joint:
    """All n-grams of either, with the (possibly backed-off) probability in each and whether each has it itself.

    Each order is one outer join of the models and one join with the order below, where what one
    of them lacks backs off; a word that a model has nowhere is null.
    """
    if a.order != b.order:
        raise ValueError("models of one order merge")
    alphas = kept(a.backoffs.select("hist", F.col("alpha").alias("a1")).join(b.backoffs.select("hist", F.col("alpha").alias("a2")), "hist", "full_outer").select("hist", F.coalesce("a1", F.lit(1.0)).alias("a1"), F.coalesce("a2", F.lit(1.0)).alias("a2")), "alphas")
    done = below = None
    for n in range(1, a.order + 1):
        one = a.grams.where(F.col("ord") == n).select(*GRAM, F.col("p").alias("p1"))
        two = b.grams.where(F.col("ord") == n).select(*GRAM, F.col("p").alias("p2"))
        rows = one.join(two, GRAM, "full_outer").withColumns({"in1": F.col("p1").isNotNull(), "in2": F.col("p2").isNotNull()})
        if n == 1:
            none = F.lit(None).cast("double")
            rows = rows.withColumns({"low1": none, "low2": none})
        else:
            low = below.select(F.col("hist").alias("_low"), "word", F.col("p1").alias("low1"), F.col("p2").alias("low2"))
            rows = rows.withColumn("_low", suffix("hist")).join(low, ["_low", "word"], "left").join(alphas, "hist", "left")
            rows = rows.withColumns({"p1": F.coalesce("p1", F.col("a1") * F.col("low1")), "p2": F.coalesce("p2", F.col("a2") * F.col("low2"))})
        below = kept(rows.select(*GRAM, "p1", "p2", "in1", "in2", "low1", "low2"), "joint")
        done = below if done is None else done.unionByName(below)
    return Joint(done, alphas)


def _both(a: Model, b: Model) -> DataFrame:
    return joint(a, b).grams.select(*GRAM, "p1", "p2", "in1", "in2")


def merge_models(a: Model, b: Model, alpha: float = 1.0, beta: float = 1.0) -> Model:
    """Linear interpolation; where an n-gram is absent its backed-off probability stands."""
    p = (alpha * F.coalesce("p1", F.lit(0.0)) + beta * F.coalesce("p2", F.lit(0.0))) / (alpha + beta)
    grams = _both(a, b).select(*GRAM, p.alias("p"))
    return Model(grams, backoffs(grams, a.order), a.order)


def merge_bayes(a: Model, b: Model, alpha: float = 1.0, beta: float = 1.0) -> Model:
    """Weights for each history by how likely either model finds it."""
    from .scoring import history_probability

    h1 = history_probability(a).select("hist", F.col("ph").alias("q1"))
    h2 = history_probability(b).select("hist", F.col("ph").alias("q2"))
    rows = _both(a, b).join(h1, "hist", "left").join(h2, "hist", "left")
    x, y = alpha * F.coalesce("q1", F.lit(0.0)), beta * F.coalesce("q2", F.lit(0.0))
    share = F.when(x + y > 0, x / (x + y)).otherwise(F.lit(alpha / (alpha + beta)))
    grams = rows.select(*GRAM, (share * F.coalesce("p1", F.lit(0.0)) + (1 - share) * F.coalesce("p2", F.lit(0.0))).alias("p"))
    return Model(grams, backoffs(grams, a.order), a.order)


def merge_histograms(a: DataFrame, b: DataFrame, bins: int = 6) -> DataFrame:
    """Expected counts add and distributions convolve; weights play no part. Columns ord, hist, word, expected, p."""
    from .counting import convolved

    one = a.select(*GRAM, F.col("expected").alias("e1"), F.col("p").alias("d1"))
    two = b.select(*GRAM, F.col("expected").alias("e2"), F.col("p").alias("d2"))
    none = F.array(F.lit(1.0), *(F.lit(0.0) for _ in range(bins - 1)))
    rows = one.join(two, GRAM, "full_outer")
    return rows.select(*GRAM, (F.coalesce("e1", F.lit(0.0)) + F.coalesce("e2", F.lit(0.0))).alias("expected"), convolved(F.coalesce("d1", none), F.coalesce("d2", none), bins).alias("p"))


def merge_replace(a: DataFrame, b: DataFrame, upto: int) -> DataFrame:
    """n-grams up to an order from b, longer ones from a."""
    return b.where(F.col("ord") <= upto).unionByName(a.where(F.col("ord") > upto))


def replace_faults(a: DataFrame, b: DataFrame, upto: int) -> DataFrame:
    """n-grams of a up to the order that b lacks: there should be none."""
    return a.where(F.col("ord") <= upto).join(b, GRAM, "left_anti").select(*GRAM)


# Contexts: half-open intervals in the order of reversed histories, [begin, end).


def reversed_history(hist: Column, labels: Column | None = None) -> Column:
    """The words of a history, the last one first, as an array that orders."""
    return F.reverse(F.filter(F.split(hist, " "), lambda w: w != ""))


def in_context(hist: Column, begin: list[str], end: list[str]) -> Column:
    """Whether a history lies in an interval of reversed contexts; an empty end is no bound."""
    h = reversed_history(hist)
    low = h >= F.array(*map(F.lit, begin)).cast("array<string>") if begin else F.lit(True)
    return low & (h < F.array(*map(F.lit, end)).cast("array<string>")) if end else low


def check_contexts(intervals: list[tuple[list[str], list[str]]]) -> list[tuple[list[str], list[str]]]:
    """Sorted, neighbours joined; an overlap is an error."""
    out: list[tuple[list[str], list[str]]] = []
    for begin, end in sorted(intervals):
        if out and (not out[-1][1] or out[-1][1] > begin):
            raise ValueError(f"contexts overlap: {out[-1]} and {(begin, end)}")
        if out and out[-1][1] == begin:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def split(counts: DataFrame, bounds: list[list[str]]) -> DataFrame:
    """Adds the number of the context that holds each n-gram's history; bounds: where each but the first begins, ascending."""
    h = reversed_history(F.col("hist"))
    part = F.lit(0)
    for k, b in enumerate(bounds, 1):
        part = F.when(h >= F.array(*map(F.lit, b)), k).otherwise(part)
    return counts.withColumn("context", part)


def choose_contexts(counts: DataFrame, parts: int) -> list[list[str]]:
    """Bounds that give each part about the same mass of counts of bigrams, by the last word of the history.

    Words are dealt to many more ranges than parts; the driver sees the first word and the
    mass of each range, and cuts where the mass passes the next share.
    """
    sums = counts.where("ord = 2").groupBy(F.col("hist").alias("w")).agg(F.sum("c").cast("double").alias("c"))
    ranged = sums.repartitionByRange(64 * parts, "w").groupBy(F.spark_partition_id().alias("k")).agg(F.min("w").alias("begin"), F.sum("c").alias("mass")).collect()
    ranges = sorted((r["begin"], r["mass"]) for r in ranged)
    total, upto, out = sum(m for _, m in ranges), 0.0, []
    for begin, mass in ranges:
        if upto >= (len(out) + 1) * total / parts and len(out) < parts - 1:
            out.append([begin])
        upto += mass
    return out


def in_extended(hist: Column, begin: list[str], end: list[str]) -> Column:
    """Whether a history is in a context, or is a suffix of one that is: it may be needed there."""
    h = reversed_history(hist)
    bound = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    starts = lambda x: (F.size(h) <= len(x)) & (h == F.slice(bound(x), F.lit(1), F.size(h))) if x else F.lit(False)
    return in_context(hist, begin, end) | starts(begin) | (F.size(h) == 0)


def merge_context(a: DataFrame, b: DataFrame, inside: Column, value: str = "p") -> DataFrame:
    """An n-gram of both: b's value if its history is in context, else a's; of one: its value. inside: on column hist."""
    one = a.select(*GRAM, F.col(value).alias("_1"))
    two = b.select(*GRAM, F.col(value).alias("_2"))
    rows = one.join(two, GRAM, "full_outer")
    v = F.when(F.col("_1").isNotNull() & F.col("_2").isNotNull() & inside, F.col("_2")).otherwise(F.coalesce("_1", "_2"))
    return rows.select(*GRAM, v.alias(value))


def context_prune(grams: DataFrame, inside: Column, order: int) -> DataFrame:
    """Only n-grams in context, with the shorter ones that they need."""
    left = grams.where(inside | (F.col("ord") == 1))
    need = left.select(*GRAM)
    for _ in range(order - 1):
        need = need.unionByName(need.where("ord > 1").select((F.col("ord") - 1).alias("ord"), suffix("hist").alias("hist"), "word")).distinct()
    return grams.join(need, GRAM, "left_semi")
