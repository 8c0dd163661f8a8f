"""Tokens of a text, vocabularies, and the mapping of unknown words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS, EPSILON, UNK = "<s>", "</s>", "<epsilon>", "<UNK>"
BLANKS = "[ \\t\\n\\r\\f]+"


def tokens(text: Column) -> Column:
    """Non-empty runs between blanks; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, BLANKS), ""), F.array().cast("array<string>"))


def padded(words: Column) -> Column:
    """One begin and one end mark."""
    return F.concat(F.array(F.lit(BOS)), words, F.array(F.lit(EOS)))


def bytes_of(text: Column) -> Column:
    """Byte labels 1..255 of the UTF-8 of a text (byte token mode)."""
    raw = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(raw) / 2).cast("int") - 1), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def codepoints(text: Column) -> Column:
    """Code points of a text (utf8 token mode)."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def vocabulary(texts: DataFrame, text: str = "text", unknown: str = UNK) -> DataFrame:
    """(symbol, label): epsilon 0, then the distinct tokens in order, then the unknown symbol.

    Labels come from ranges: partition-wise numbers plus the sizes before them, no single task.
    """
    words = texts.select(F.explode(tokens(F.col(text))).alias("symbol")).distinct()
    spark = texts.sparkSession
    ranged = words.repartitionByRange("symbol").withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("symbol")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = local.join(F.broadcast(before), "part").select("symbol", (F.col("k") + F.col("before")).cast("bigint").alias("label"))
    ends = words.agg(F.count("*").alias("n")).select(F.lit(unknown).alias("symbol"), (F.col("n") + 1).cast("bigint").alias("label"))
    return spark.createDataFrame([(EPSILON, 0)], "symbol string, label bigint").unionByName(numbered).unionByName(ends)


def known(words: Column, vocabulary: Column, unknown: str = UNK) -> Column:
    """Words outside an array of known ones become the unknown symbol."""
    return F.transform(words, lambda w: F.when(F.array_contains(vocabulary, w), w).otherwise(F.lit(unknown)))
