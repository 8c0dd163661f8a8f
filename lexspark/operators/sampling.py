"""Random sentences of a backoff model of any size, by joins.

The words of each history lie one after the other on a line as long as their probabilities
together, and the line is cut into as many cells as the history has words; a draw falls into
a cell, where a word or two are to be compared. All sentences draw at once, a word or a step
down to a shorter history in a round: what the line leaves of 1 is the chance to step down,
and a word that a longer history has itself is drawn again there.

The model stays where it is: a round's draws are sent to it if there are few sentences, and
are shuffled to it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import BOS, EOS
from ..tables import discard, kept, stored
from .smoothing import Model

#: Words of a history whose masses one task sums along.
BUCKET = 1_024
#: Up to here the draws of a round, of some 100 bytes each, are sent to all tasks.
FEW = 100_000


def lines(model: Model) -> tuple[DataFrame, DataFrame]:
    """heads (hist, mass, m): the probability of a history's words together, and their number; cells (hist, cell, word, lo, hi)."""
    grams = model.grams.select("hist", "word", "p").where("p > 0")
    sizes = kept(grams.groupBy("hist").agg(F.count("*").alias("m")), "sizes")
    one = F.broadcast(sizes.where("hist = ''").select("m"))  # a row
    rows = grams.where("hist != ''").join(sizes.where("hist != ''"), "hist").unionByName(grams.where("hist = ''").crossJoin(one))
    rows = kept(rows.withColumn("bucket", F.pmod(F.xxhash64("word"), F.ceil(F.col("m") / BUCKET))), "buckets")
    sums = rows.groupBy("hist", "bucket").agg(F.sum("p").alias("s"))
    before = Window.partitionBy("hist").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("hist", "bucket", "s", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("start"))
    starts = kept(starts, "starts")
    heads = kept(starts.groupBy("hist").agg(F.max(F.col("start") + F.col("s")).alias("mass")).join(sizes, "hist"), "heads")
    inside = Window.partitionBy("hist", "bucket").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, ["hist", "bucket"]).withColumn("hi", F.sum("p").over(inside)).select("hist", "word", "m", (F.col("start") + F.col("hi") - F.col("p")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    top = placed.where("hist = ''").crossJoin(F.broadcast(heads.where("hist = ''").select("mass")))
    placed = placed.where("hist != ''").join(heads.select("hist", "mass"), "hist").unionByName(top)
    at = lambda c: F.least(F.floor(F.col(c) / F.col("mass") * F.col("m")), F.col("m") - 1)
    cells = placed.select("hist", F.explode(F.sequence(at("lo"), at("hi"))).alias("cell"), "word", "lo", "hi")
    return heads, kept(cells, "cells")


def _uniform(seed: int, *names: str) -> Column:
    """A number from 0 to 1 that depends on these columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / F.lit(float(1 << 53))


def _cut(n: Column) -> Column:
    """The last n words of the history."""
    words = F.filter(F.split("hist", " "), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.least(n, F.size(words))), " ")


def draws(spark: SparkSession, model: Model, n: int, seed: int = 0, most: int = 1_000) -> DataFrame:
    """(id, pos, word): the words of n sentences, the end mark with them, up to ``most`` words each.

    A draw depends on the seed, the sentence, the place and the attempt, so that a lost task
    draws the same again.
    """
    heads, cells = lines(model)
    grams = model.grams.select(F.col("hist").alias("_above"), F.col("word").alias("_word"))
    few = (lambda df: F.broadcast(df)) if n <= FEW else (lambda df: df)
    top = model.order - 1
    first = F.lit(BOS if top else "")
    live = spark.range(n).select("id", F.lit(1).alias("pos"), first.alias("hist"), F.lit(min(1, top)).alias("level"), F.lit(0).alias("try"))
    done = None
    last: str | None = None
    while True:
        live = live.select("*", _cut(F.col("level")).alias("_at"), _cut(F.col("level") + 1).alias("_above"), _uniform(seed, "id", "pos", "level", "try").alias("_u"))
        found = heads.join(few(live.select("id", F.col("_at").alias("hist"), "_u", "level")), "hist").select("id", "hist", "m", "mass", F.when(F.col("level") == 0, F.col("_u") * F.col("mass")).otherwise(F.col("_u")).alias("x")).where("x < mass")
        found = found.select("id", "hist", "x", F.least(F.floor(F.col("x") / F.col("mass") * F.col("m")), F.col("m") - 1).alias("cell"))
        hit = cells.join(few(found), ["hist", "cell"]).where("x >= lo and x < hi").select("id", "word")
        drawn = live.join(found.select("id", F.lit(True).alias("_in")), "id", "left").join(hit, "id", "left")
        asked = drawn.where("word is not null and _above != _at").select("id", "_above", F.col("word").alias("_word"))
        barred = grams.join(few(asked), ["_above", "_word"]).select("id", F.lit(True).alias("_barred"))
        step, path = stored(drawn.join(barred, "id", "left").select("id", "pos", "hist", "level", "try", F.coalesce("_in", F.lit(False)).alias("inside"), F.when(F.col("_barred").isNull(), F.col("word")).alias("word")), "draws")
        if last:
            discard(spark, last)
        got = step.where("word is not null")
        out = kept(got.select("id", "pos", "word"), "drawn")
        done = out if done is None else done.unionByName(out)
        # A word was drawn: the next place. Else the draw lay beyond the words: a shorter history; or within, and is repeated.
        went = got.where((F.col("word") != EOS) & (F.col("pos") < most)).select("id", (F.col("pos") + 1).alias("pos"), _grown(top).alias("hist"), F.lit(0).alias("try")).withColumn("level", F.size(F.filter(F.split("hist", " "), lambda w: w != "")))
        down = step.where("word is null").select("id", "pos", "hist", F.when(F.col("inside") | (F.col("level") == 0), F.col("level")).otherwise(F.col("level") - 1).alias("level"), (F.col("try") + 1).alias("try"))
        live, last = went.unionByName(down), path
        if live.isEmpty():
            discard(spark, last)
            return done


def _grown(top: int) -> Column:
    """The history with the word that was drawn, at most ``top`` words."""
    if not top:
        return F.lit("")
    return F.substring_index(F.concat_ws(" ", F.when(F.col("hist") != "", F.col("hist")), "word"), " ", -top)


def sentences(spark: SparkSession, model: Model, n: int, seed: int = 0, most: int = 1_000) -> DataFrame:
    """(id, text): n random sentences, of up to ``most`` words each."""
    words = draws(spark, model, n, seed, most)
    return words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select("id", F.array_join(F.filter(F.transform("w", lambda x: x["word"]), lambda w: w != EOS), " ").alias("text"))
