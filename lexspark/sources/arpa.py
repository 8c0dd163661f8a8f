"""ARPA files: reading, with holes filled, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semiring import INF_BACKOFF
from ..functions.tokens import BOS
from ..operators.counting import head, ngram, suffix, tail
from ..operators.shrinking import complete
from ..operators.smoothing import Model, backoffs


def lines(model: Model) -> DataFrame:
    """(section, key, line): the lines of an ARPA file; sections 0 header, n the n-grams of an order, -1 the end."""
    g, b = model.grams, model.backoffs.select(F.col("hist").alias("_g"), "alpha")
    sizes = g.groupBy("ord").agg(F.count("*").alias("n"))
    begin = F.when(F.col("ord") == 1, 1).otherwise(0)  # the begin mark is listed, with no probability
    header = sizes.select(F.lit(0).alias("section"), F.col("ord").cast("string").alias("key"), F.format_string("ngram %d=%d", "ord", F.col("n") + begin).alias("line"))
    rows = g.select("ord", ngram().alias("gram"), "p").join(b, F.col("gram") == F.col("_g"), "left")
    start = model.backoffs.where(F.col("hist") == BOS).select(F.lit(1).alias("ord"), F.lit(BOS).alias("gram"), F.lit(None).cast("double").alias("p"), F.lit(BOS).alias("_g"), "alpha")
    rows = rows.unionByName(start)
    score = F.when(F.col("p").isNull(), F.lit("-99")).otherwise(F.format_string("%.6f", F.log10("p")))
    text = F.concat(score, F.lit("\t"), F.col("gram"), F.when(F.col("alpha").isNotNull(), F.concat(F.lit("\t"), F.format_string("%.6f", F.log10("alpha")))).otherwise(F.lit("")))
    return header.unionByName(rows.select(F.col("ord").alias("section"), F.col("gram").alias("key"), text.alias("line")))


def write(model: Model, path: str) -> None:
    """An ordered text file in numbered parts, each written by a task of its own: joined in the order of their names they are the file."""
    made = lines(model)
    spark = made.sparkSession
    marks = [(0, 0, "", ""), (0, 1, "", "\\data\\"), *((n, 0, "", "") for n in range(1, model.order + 1)), *((n, 1, "", f"\\{n}-grams:") for n in range(1, model.order + 1)), (model.order + 1, 0, "", ""), (model.order + 1, 1, "", "\\end\\")]
    frame = spark.createDataFrame(marks, "section int, at int, key string, line string")
    made.select("section", F.lit(2).alias("at"), "key", "line").unionByName(frame).orderBy("section", "at", "key").select("line").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, renormalise: bool = False) -> Model:
    """log10 to probabilities; missing suffixes are added with their backed-off probability."""
    raw = spark.read.text(path).where("value rlike '^-?[0-9.]+(e[-+]?[0-9]+)?[\\\\t ]'")
    parts = F.split("value", "[\t ]+")
    at = raw.select(parts.alias("x"), F.split("value", "\t").alias("y"))
    rows = at.select(F.pow(F.lit(10.0), F.col("x")[0].cast("double")).alias("p"), F.when(F.size("y") > 1, F.col("y")[1]).otherwise(F.array_join(F.slice("x", 2, 99), " ")).alias("gram"), F.when(F.size("y") > 2, F.pow(F.lit(10.0), F.get("y", F.lit(2)).cast("double"))).alias("alpha"))
    rows = rows.withColumn("ord", F.size(F.split("gram", " ")))
    order = rows.agg(F.max("ord")).first()[0]
    grams = rows.where(F.col("gram") != BOS).select("ord", head(F.col("gram")).alias("hist"), tail(F.col("gram")).alias("word"), "p")
    alphas = rows.where("alpha is not null").select(F.col("gram").alias("hist"), "alpha")
    lost = complete(grams, order).join(grams, ["ord", "hist", "word"], "left_anti")
    for n in range(2, order + 1):
        below = grams.where(F.col("ord") == n - 1).select(F.col("hist").alias("low"), "word", "p")
        fill = lost.where(F.col("ord") == n).withColumn("low", suffix("hist")).join(below, ["low", "word"]).join(alphas, "hist", "left")
        grams = grams.unionByName(fill.select("ord", "hist", "word", (F.col("p") * F.coalesce("alpha", F.lit(1.0))).alias("p")))
    return Model(grams, backoffs(grams, order) if renormalise else alphas, order, {"infinite": INF_BACKOFF})
