"""Models as Markov chains over their histories, and two models at once, by joins.

A chain's states are the histories of a model: few rows beside its n-grams. Mass that backs
off moves as one sum for each suffix, and what it must not do (words that the longer history
has itself) is taken off along the edges, so that no edge is made for a backed-off word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import NORM_EPS
from ..functions.tokens import BOS, EOS
from ..tables import discard, kept, stored
from .counting import suffix
from .merging import Joint, joint
from .scoring import history_probability
from .smoothing import Model, backoffs

#: Fixed value: the chance that a text is followed by another one, as the chain is closed.
REENTRY = 0.999999


def _length(hist: str = "hist"):
    return F.when(F.col(hist) == "", 0).otherwise(F.size(F.split(hist, " ")))


def destinations(rows: DataFrame, histories: DataFrame, order: int, hist: str = "hist", out: str = "dest") -> DataFrame:
    """Adds the history that each (hist, word) leads to: the longest suffix of both that is one. The end mark leads to the begin mark."""
    whole = F.concat_ws(" ", F.when(F.col(hist) != "", F.col(hist)), "word")
    rows = rows.withColumn("_gram", F.when(F.col("word") == EOS, F.lit(BOS)).otherwise(whole)).withColumn("_size", F.size(F.split("_gram", " ")))
    found = F.lit("")
    for n in range(1, order):
        known = histories.where(_length() == n).select(F.col("hist").alias(f"_d{n}"))
        rows = rows.join(known, F.when(F.col("_size") >= n, F.substring_index("_gram", " ", -n)) == F.col(f"_d{n}"), "left")
        found = F.coalesce(F.col(f"_d{n}"), found)
    return rows.withColumn(out, found).drop("_gram", "_size", *(f"_d{n}" for n in range(1, order)))


def _edges(grams: DataFrame, alphas: DataFrame, histories: DataFrame, order: int, reentry: float) -> DataFrame:
    """(hist, dest, w): the mass that moves from a history for each unit that is there, less what its backed-off mass may not do.

    grams: hist, word, p and low, the probability of the word one history shorter.
    """
    again = F.when(F.col("word") == EOS, F.lit(reentry)).otherwise(F.lit(1.0))
    if order == 2:  # a word leads to the same history from a word as from none
        left = grams.join(alphas.select("hist", "alpha"), "hist", "left")
        w = F.col("p") - F.when(F.col("hist") != "", F.coalesce(F.col("alpha") * F.col("low"), F.lit(0.0))).otherwise(0.0)
        return destinations(left, histories, order).select("hist", "dest", (w * again).alias("w"))
    own = destinations(grams, histories, order).select("hist", "dest", (F.col("p") * again).alias("w"))
    high = grams.where("hist != ''").select("hist", suffix("hist").alias("below"), "word", "low").join(alphas.select("hist", "alpha"), "hist")
    back = destinations(high, histories, order, "below").select("hist", "dest", (-F.col("alpha") * F.col("low") * again).alias("w"))
    return own.unionByName(back).groupBy("hist", "dest").agg(F.sum("w").alias("w"))


def stationary(grams: DataFrame, alphas: DataFrame, histories: DataFrame, begin: DataFrame, order: int, reentry: float = REENTRY, rounds: int = 10_000, eps: float = NORM_EPS) -> DataFrame:
    """(hist, ph): the stationary distribution of the closed chain, by rounds from (hist, ph) in ``begin``.

    Rounds end when no history's share changes by more than ``eps`` of itself. The table of a
    round has a row for each history; those before it are deleted.
    """
    spark = grams.sparkSession
    histories = kept(histories, "histories")
    edges = kept(_edges(grams, alphas, histories, order, reentry), "edges")
    low, high = edges.where("hist = ''").select("dest", "w"), edges.where("hist != ''")
    alphas = kept(alphas.select("hist", "alpha"), "alphas")
    begin = histories.join(begin, "hist", "left")
    begin = begin.crossJoin(F.broadcast(begin.agg(F.sum("ph").alias("_s"))))
    now, path = stored(begin.select("hist", (F.coalesce("ph", F.lit(0.0)) / F.col("_s")).alias("ph")), "shares")
    for _ in range(rounds):
        above = now.where(_length() == order - 1)
        mass = above
        for n in range(order - 2, -1, -1):
            fall = above.join(alphas, "hist").groupBy(suffix("hist").alias("hist")).agg(F.sum(F.col("ph") * F.col("alpha")).alias("m"))
            above = now.where(_length() == n).join(fall, "hist", "left").select("hist", (F.col("ph") + F.coalesce("m", F.lit(0.0))).alias("ph"))
            if n:
                mass = mass.unionByName(above)
        # The shortest history has an edge to every word's: its one row is sent to all of them.
        moved = high.join(mass, "hist").select("dest", (F.col("w") * F.col("ph")).alias("v"))
        moved = moved.unionByName(low.crossJoin(F.broadcast(above.select(F.col("ph").alias("m")))).select("dest", (F.col("w") * F.col("m")).alias("v")))
        sums = moved.groupBy("dest").agg(F.sum("v").alias("v"))
        both, last = stored(now.join(sums, F.col("hist") == F.col("dest"), "left").select("hist", F.coalesce("v", F.lit(0.0)).alias("ph"), F.col("ph").alias("before")), "shares")
        discard(spark, path)
        now, path = both.select("hist", "ph"), last
        if both.where(F.abs(F.col("ph") - F.col("before")) > eps * F.col("before")).isEmpty():
            break
    return now


def _with_low(model: Model) -> DataFrame:
    if model.pairs is not None:
        return model.pairs.select("hist", "word", "p", F.col("q").alias("low")).unionByName(model.grams.where("ord = 1").select("hist", "word", "p", F.lit(None).cast("double").alias("low")))
    low = model.grams.select((F.col("ord") + 1).alias("ord"), F.col("hist").alias("_low"), "word", F.col("p").alias("low"))
    high = model.grams.where("ord > 1").withColumn("_low", suffix("hist")).join(low, ["ord", "_low", "word"]).select("hist", "word", "p", "low")
    return high.unionByName(model.grams.where("ord = 1").select("hist", "word", "p", F.lit(None).cast("double").alias("low")))


def stationary_histories(model: Model, reentry: float = REENTRY, rounds: int = 10_000, eps: float = NORM_EPS) -> DataFrame:
    """(hist, ph) of every history of a model, in the chain of texts that follow one another."""
    none = model.grams.sparkSession.createDataFrame([("",)], "hist string")
    histories = model.backoffs.select("hist").unionByName(none)
    return stationary(_with_low(model), model.backoffs, histories, history_probability(model), model.order, reentry, rounds, eps)


def _chain_of(both: Joint, side: str) -> DataFrame:
    """n-grams of either model with one model's probability; words that it lacks are left out."""
    return both.grams.where(f"p{side} is not null").select("hist", "word", F.col(f"p{side}").alias("p"), F.col(f"low{side}").alias("low"))


def cross_entropy(p: Model, q: Model, rounds: int = 10_000, eps: float = 1e-6) -> DataFrame:
    """(entropy, symbols, perplexity): the expected -ln q of a text of p, the expected number of its words with the end
    mark, and exp of the one over the other. Infinite if p has a word that q lacks.

    Both models are read over the histories of either. A history's own part is the sum over its n-grams of either
    model; all other words have the backed-off probability in both, so their part is that of the next shorter history
    less what it says of the listed words. How often each history is met comes from the closed chain of p.
    """
    both = joint(p, q)
    alphas = both.alphas.select("hist", "a1", "a2")
    listed = both.grams.where("p1 is not null and p1 > 0")
    minus = lambda c: F.when(F.col(c).isNull() | (F.col(c) <= 0), F.lit(float("inf"))).otherwise(-F.log(c))
    # Words that p has no mass for leave infinity times nothing: they count 0.
    unit = listed.where("ord = 1").agg(F.sum(F.col("p1") * minus("p2")).alias("t")).select(F.lit("").alias("hist"), "t")
    done = above = kept(unit, "entropies")
    for n in range(2, p.order + 1):
        own = listed.where(F.col("ord") == n).join(alphas, "hist")
        fall = -F.log("a2")
        part = F.col("p1") * minus("p2") - F.col("a1") * F.col("low1") * (fall + minus("low2"))
        part = F.when((F.col("p2") > 0) & (F.col("low2") > 0), part).otherwise(F.lit(float("inf")))
        sums = alphas.where(_length() == n - 1).join(own.groupBy("hist").agg(F.sum(part).alias("s")), "hist", "left").withColumn("_low", suffix("hist"))
        above = kept(sums.join(above.select(F.col("hist").alias("_low"), F.col("t").alias("_t")), "_low").select("hist", (F.coalesce("s", F.lit(0.0)) + F.col("a1") * (F.col("_t") - F.log("a2"))).alias("t")), "entropies")
        done = done.unionByName(above)
    histories = alphas.select("hist").unionByName(unit.select("hist"))
    chances = stationary(_chain_of(both, "1"), alphas.select("hist", F.col("a1").alias("alpha")), histories, history_probability(p).join(histories, "hist", "left_semi"), p.order, 1.0, rounds, eps)
    # Mass is counted where words are drawn: at the longest history; what it passes on is in its own part.
    sums = chances.where("ph > 0").join(done, "hist").agg(F.sum(F.col("ph") * F.col("t")).alias("h"), F.sum("ph").alias("n"), F.max(F.when(F.col("hist") == BOS, F.col("ph"))).alias("texts"))
    return sums.select((F.col("h") / F.col("texts")).alias("entropy"), (F.col("n") / F.col("texts")).alias("symbols"), F.exp(F.col("h") / F.col("n")).alias("perplexity"))


def intersected(a: Model, b: Model, normalise: bool = True) -> Model:
    """The product of two models: each n-gram of either that both have words for, times each other's, backed off on either
    side to the longest match. Backoffs multiply. With ``normalise`` each history's words and backoff sum to 1."""
    both = joint(a, b)
    grams = both.grams.where("p1 is not null and p2 is not null").select("ord", "hist", "word", (F.col("p1") * F.col("p2")).alias("p"), (F.col("low1") * F.col("low2")).alias("low"))
    alphas = both.alphas.select("hist", (F.col("a1") * F.col("a2")).alias("alpha"))
    if not normalise:
        return Model(grams.select("ord", "hist", "word", "p"), alphas, a.order)
    grams = kept(grams, "products")
    done = above = kept(grams.where("ord = 1").groupBy("hist").agg(F.sum("p").alias("z")), "masses")
    for n in range(2, a.order + 1):
        sums = grams.where(F.col("ord") == n).groupBy("hist").agg(F.sum("p").alias("own"), F.sum("low").alias("below")).join(alphas, "hist").withColumn("_low", suffix("hist"))
        low = above.select(F.col("hist").alias("_low"), F.col("z").alias("_z"))
        above = kept(sums.join(low, "_low").select("hist", (F.col("own") + F.col("alpha") * F.greatest(F.col("_z") - F.col("below"), F.lit(0.0))).alias("z")), "masses")
        done = done.unionByName(above)
    scaled = kept(grams.where("ord > 1").join(done.where("hist != ''"), "hist").unionByName(grams.where("ord = 1").crossJoin(F.broadcast(done.where("hist = ''").select("z")))).select("ord", "hist", "word", (F.col("p") / F.col("z")).alias("p")), "scaled")
    return Model(scaled, backoffs(scaled, a.order), a.order)

