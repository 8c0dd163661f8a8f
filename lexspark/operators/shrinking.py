"""Pruning of models and counts.

Scores are computed once on the whole model, the highest order first; an n-gram's
effective score is the largest of its own and those of its extensions by one word on
either side. An n-gram that a longer survivor needs stays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import BOS
from ..tables import kept
from .counting import head, ngram, suffix, tail
from .scoring import history_probability
from .smoothing import Model, alpha, backoffs, vocabulary_size


def _scored(model: Model) -> DataFrame:
    """Each n-gram of order 2 or more with what the criteria need: p, q (below), alpha and its parts, ph."""
    pairs = model.pairs
    if pairs is None:
        low = model.grams.select((F.col("ord") + 1).alias("ord"), F.col("hist").alias("low"), "word", F.col("p").alias("q"))
        pairs = kept(model.grams.where("ord > 1").withColumn("low", suffix("hist")).join(low, ["ord", "low", "word"]), "pairs")
    own = Window.partitionBy("hist")
    high = pairs.select("ord", "hist", "word", "p", "q", (1 - F.sum("p").over(own)).alias("num"), (1 - F.sum("q").over(own)).alias("den"), *([F.count("*").over(own).alias("n")] if model.pairs is not None else []))
    if model.pairs is not None:
        high = high.crossJoin(F.broadcast(vocabulary_size(model.grams))).withColumn("alpha", alpha(F.col("num"), F.col("den"))).drop("n", "v")
    else:
        high = high.join(model.backoffs, "hist")
    high = high.join(history_probability(model), "hist", "left")
    return high.withColumn("alpha2", (F.col("num") + F.col("p")) / (F.col("den") + F.col("q"))).withColumn("ph", F.coalesce("ph", F.lit(0.0)))


def relative_entropy_scores(model: Model) -> DataFrame:
    """(ord, hist, word, score): the growth of relative entropy if the n-gram goes."""
    lost = F.col("p") * (F.log("q") + F.log("alpha2") - F.log("p")) + F.col("num") * (F.log("alpha2") - F.log("alpha"))
    return _scored(model).select("ord", "hist", "word", (-F.col("ph") * lost).alias("score"))


def estimated_total(model: Model) -> float:
    """How many unigrams were counted, from the two smallest probabilities: they differ by one count."""
    low = [r["p"] for r in model.grams.where("ord = 1").select("p").distinct().orderBy("p").limit(2).collect()]
    return 1 / (low[1] - low[0]) if len(low) > 1 else 1 / low[0]


def seymore_scores(model: Model, total: float | None = None) -> DataFrame:
    """(ord, hist, word, score): total p(h, w) (log p(w|h) - log of its backed-off probability). Without a total, the estimated one."""
    total = estimated_total(model) if total is None else total
    kept = F.col("ph") * F.col("p") * (F.log("p") - F.log(F.col("alpha2") * F.col("q")))
    return _scored(model).select("ord", "hist", "word", (total * kept).alias("score"))


def propagated(scores: DataFrame, order: int) -> DataFrame:
    """Scores raised to those of their extensions, by way of the suffix and of the prefix, the highest order first."""
    out = above = scores.where(F.col("ord") == order).select("ord", "hist", "word", "score")
    for n in range(order - 1, 1, -1):
        own = scores.where(F.col("ord") == n).select("ord", "hist", "word", "score")
        by_suffix = above.groupBy(suffix("hist").alias("hist"), "word").agg(F.max("score").alias("a"))
        by_prefix = above.groupBy("hist").agg(F.max("score").alias("b")).select(head(F.col("hist")).alias("hist"), tail(F.col("hist")).alias("word"), "b")
        above = own.join(by_suffix, ["hist", "word"], "left").join(by_prefix, ["hist", "word"], "left").select("ord", "hist", "word", F.greatest("score", "a", "b").alias("score"))
        out = out.unionByName(above)
    return out


def shrink(model: Model, scores: DataFrame, theta: float, strict: bool = True, least_order: int = 2, inside: Column | None = None, written: bool = True) -> Model:
    """Without the n-grams whose effective score is below theta; backoffs anew. written: False if the n-grams are read once, or not at all.

    least_order: n-grams of fewer words stay. inside: a condition on the column hist; only
    n-grams in that context stay besides, with the shorter ones that they need.
    """
    from .merging import context_prune

    effective = propagated(scores, model.order)
    gone = effective.where((F.col("score") < theta if strict else F.col("score") <= theta) & (F.col("ord") >= least_order)).select("ord", "hist", "word")
    left = model.grams.join(gone, ["ord", "hist", "word"], "left_anti")
    if inside is not None:
        left = context_prune(left, inside | (F.col("ord") < least_order), model.order)
    left = kept(left, "shrunk") if written else left
    return Model(left, backoffs(left, model.order), model.order)


def relative_entropy(model: Model, theta: float, **options) -> Model:
    from math import log1p

    return shrink(model, relative_entropy_scores(model), log1p(theta), **options)


def seymore(model: Model, theta: float, total: float | None = None, **options) -> Model:
    return shrink(model, seymore_scores(model, total), theta, **options)


def theta_for_size(model: Model, scores: DataFrame, target: int) -> float:
    """Between the score of the last n-gram kept and of the first that goes, for a number of n-grams; ties go together.

    Distinct scores are dealt to ranges; the driver sees one count for each range, and only
    the range that holds the border is summed along.
    """
    effective = propagated(scores, model.order)
    room = target - model.grams.where("ord = 1").count()
    ends = effective.groupBy("score").agg(F.count("*").alias("n"))
    ranged = kept(ends.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy(F.desc("high")).collect()
    upto, last = 0, None
    for r in sizes:
        if upto + r["n"] > room:
            own = ranged.where(F.col("part") == r["part"]).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score"))) + upto)
            found = own.agg(F.min(F.when(F.col("upto") <= room, F.col("score"))).alias("last"), F.max(F.when(F.col("upto") > room, F.col("score"))).alias("next")).first()
            last = found["last"] if found["last"] is not None else last
            return (last + found["next"]) / 2 if last is not None else float("inf")
        upto, last = upto + r["n"], r["low"]
    return float("-inf")


def count_prune(counts: DataFrame, pattern: str, order: int) -> DataFrame:
    """By a pattern such as ``2:2;3+:3``: n-grams of an order with a count below the number go, if no survivor needs them."""
    least = {}
    for part in filter(None, pattern.split(";")):
        m = re.fullmatch(r"(\d+)(\+?):(\d+(?:\.\d+)?)", part)
        if not m:
            raise ValueError(f"not a pruning pattern: {part}")
        for n in range(int(m[1]), order + 1 if m[2] else int(m[1]) + 1):
            least[n] = float(m[3])
    out = above = None
    for n in range(order, 0, -1):
        own = counts.where(F.col("ord") == n)
        keep = F.col("c") >= least.get(n, 0.0)
        if above is not None and n in least:
            by_suffix = above.select(suffix("hist").alias("hist"), "word")
            by_prefix = above.select(head(F.col("hist")).alias("hist"), tail(F.col("hist")).alias("word"))
            # Only what the pattern removes is looked up among what is needed.
            own = own.where(keep).unionByName(own.where(~F.coalesce(keep, F.lit(False))).join(by_suffix.unionByName(by_prefix).distinct(), ["hist", "word"], "left_semi").select(*counts.columns))
        else:
            own = own.where(keep)
        above = own.select(*counts.columns)
        out = above if out is None else out.unionByName(above)
    return out


#: Fixed value: n-grams of a list that goes with the plan.
SHORT_LIST = 1000


def list_prune(grams: DataFrame, listed: DataFrame, order: int, retry_lower: bool = False) -> DataFrame:
    """Without each listed n-gram (column ngram) and all that contain one; unigrams stay.

    retry_lower: a listed n-gram with a word that isn't in the table is taken in lower case.
    """
    wanted = listed.select("ngram").where("ngram is not null").distinct()
    if retry_lower:
        words = wanted.select("ngram", F.explode(F.split("ngram", " ")).alias("word")).join(grams.where("ord = 1").select("word", F.lit(1).alias("known")), "word", "left")
        wanted = words.groupBy("ngram").agg(F.count("*").alias("n"), F.count("known").alias("k")).select(F.when(F.col("n") == F.col("k"), F.col("ngram")).otherwise(F.lower("ngram")).alias("ngram")).distinct()
    wanted = kept(wanted, "listed")
    lengths = sorted(r[0] for r in wanted.select(F.size(F.split("ngram", " "))).distinct().collect() if r[0] <= order)  # the order at most
    words = F.split(ngram(), " ")
    if not lengths:
        return grams

    def runs(k: int) -> Column:
        if k == 1:
            return words
        at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    parts = F.flatten(F.array(*map(runs, lengths)))
    short = [r["ngram"] for r in wanted.limit(SHORT_LIST + 1).collect()]
    if len(short) <= SHORT_LIST:  # looked up in each row, with no join
        return grams.where((F.col("ord") == 1) | ~F.arrays_overlap(parts, F.array(*map(F.lit, short))))
    grams = kept(grams, "grams")
    hit = grams.where("ord > 1").select("ord", "hist", "word", F.explode(parts).alias("part")).join(wanted.select(F.col("ngram").alias("part")), "part", "left_semi").select("ord", "hist", "word").distinct()
    return grams.join(hit, ["ord", "hist", "word"], "left_anti")


def complete(grams: DataFrame, order: int) -> DataFrame:
    """(ord, hist, word) of all n-grams with every suffix of theirs."""
    rows = kept(grams.select("ord", "hist", "word"), "grams")
    level = rows.where(F.col("ord") >= order).distinct()
    out = level
    for n in range(order - 1, 0, -1):
        below = level.where(F.col("ord") == n + 1).select(F.lit(n).alias("ord"), suffix("hist").alias("hist"), "word")
        level = rows.where(F.col("ord") == n).unionByName(below).distinct()
        out = out.unionByName(level)
    return out.where(~((F.col("ord") == 1) & (F.col("word") == BOS)))


def greedy(model: Model, theta: float, least_order: int = 2) -> Model:
    """One n-gram at a time within each history, the cheapest first, with its backoff sums kept up to date.

    The highest order goes first; an n-gram that a longer survivor needs stays. Words of a
    history with the same p and q cost the same at any time: what meets in a task are such
    classes with a count each, summed before the shuffle, and a frequent history has few of
    them beside its words. Of a class that goes in part, the last words go. ``greedy.removals``
    says how prices are kept.
    """
    from .greedy import by_history

    raw = kept(_scored(model).select("ord", "hist", "word", "p", "q", "num", "den", "ph"), "scored")
    gone = above = None
    for n in range(model.order, least_order - 1, -1):
        own = raw.where(F.col("ord") == n)
        if above is not None:
            by_suffix = above.select(suffix("hist").alias("hist"), "word")
            by_prefix = above.select(head(F.col("hist")).alias("hist"), tail(F.col("hist")).alias("word"))
            free = own.join(by_suffix.unionByName(by_prefix).distinct(), ["hist", "word"], "left_anti")
        else:
            free = own
        free = kept(free, "free")
        classes = free.groupBy("hist", "p", "q").agg(F.count("*").alias("n"), F.max("word").alias("last"), F.first("num").alias("num"), F.first("den").alias("den"), F.first("ph").alias("ph"))

        sorted_ = classes.repartition("hist").sortWithinPartitions("hist", "last")
        picked = kept(sorted_.mapInArrow(by_history(theta), "hist string, p double, q double, n bigint, k bigint"), "picked")
        whole = free.join(picked.where("k = n").select("hist", "p", "q"), ["hist", "p", "q"], "left_semi").select("ord", "hist", "word")
        last = Window.partitionBy("hist", "p", "q").orderBy(F.desc("word"))
        part = free.join(picked.where("k < n").select("hist", "p", "q", "k"), ["hist", "p", "q"]).withColumn("r", F.row_number().over(last)).where("r <= k").select("ord", "hist", "word")
        out = kept(whole.unionByName(part), "gone")
        above = own.join(out, ["ord", "hist", "word"], "left_anti")
        gone = out if gone is None else gone.unionByName(out)
    left = model.grams if gone is None else kept(model.grams.join(gone, ["ord", "hist", "word"], "left_anti"), "shrunk")
    return Model(left, backoffs(left, model.order), model.order)


def shrunk(model: Model, method: str, theta: float = 0.0, target: int | None = None, total: float | None = None, least_order: int = 2, inside: Column | None = None, one_by_one: bool = False, listed: DataFrame | None = None, retry_lower: bool = False, written: bool = True) -> Model:
    """Shrinking by the name of a method: relative_entropy, seymore, list_prune or context_prune.

    Counts are pruned by ``count_prune`` and, in a context, ``merging.context_prune``.
    """
    from .merging import context_prune

    if least_order < 2:
        raise ValueError("unigrams are never removed: the least order is 2")
    if inside is not None and (one_by_one or target is not None):
        raise ValueError("a context excludes a target size and removal one by one")
    if method in ("list_prune", "context_prune"):
        if (listed if method == "list_prune" else inside) is None:
            raise ValueError(f"{method} needs its list or context")
        left = list_prune(model.grams, listed, model.order, retry_lower) if method == "list_prune" else context_prune(model.grams, inside, model.order)
        left = kept(left, "shrunk")
        return Model(left, backoffs(left, model.order), model.order)
    if method not in ("relative_entropy", "seymore"):
        raise ValueError(f"unknown method: {method}")
    if one_by_one:
        if method != "relative_entropy":
            raise ValueError("only relative entropy goes one by one")
        return greedy(model, theta, least_order)
    scores = kept(relative_entropy_scores(model) if method == "relative_entropy" else seymore_scores(model, total), "scores")
    if target is not None:
        theta = theta_for_size(model, scores.where(F.col("ord") >= least_order), target)
    elif method == "relative_entropy":
        from math import log1p

        theta = log1p(theta)
    return shrink(model, scores, theta, least_order=least_order, inside=inside, written=written)
