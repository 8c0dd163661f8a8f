"""Plain files: strings, string pairs, n-gram counts, symbol tables, weighted arcs and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semiring import neg_log
from ..operators.counting import head, ngram, tail

KEPT = ""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines; what follows an unescaped # goes, and \\# stands for #."""
    bare = F.regexp_replace(F.regexp_replace("value", r"\\#", KEPT), "#.*$", "")
    return spark.read.text(path).select(F.regexp_replace(bare, KEPT, "#").alias("line")).where(F.trim("line") != "")


def string_file(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path)


def column_file(spark: SparkSession, path: str) -> DataFrame:
    """(istring, ostring, weight) from lines of one to three tab columns. More columns, or a weight that is no number, are an error."""
    cells = F.split("line", "\t")
    wrong = lambda what: F.raise_error(F.concat(F.lit(what + ": "), F.col("line")))
    rows = _lines(spark, path).select("line", F.when(F.size(cells) <= 3, cells).otherwise(wrong("more than three columns")).alias("x"))
    raw = F.trim(F.get("x", F.lit(2)))
    number = raw.try_cast("double")
    weight = F.when(raw.isNull() | (raw == ""), F.lit(0.0)).when(raw.rlike("(?i)^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[-+]?[0-9]+)?$|^[-+]?inf(inity)?$"), number).otherwise(wrong("not a weight").cast("double"))
    return rows.select(F.get("x", F.lit(0)).alias("istring"), F.coalesce(F.get("x", F.lit(1)), F.get("x", F.lit(0))).alias("ostring"), weight.alias("weight"))


def ngram_lines(counts: DataFrame, value: str = "c", negative_logs: bool = False, integers: bool = False) -> DataFrame:
    """(line): n-gram, tab, value."""
    v: Column = neg_log(F.col(value).cast("double")) if negative_logs else F.col(value)
    return counts.select(F.concat(ngram(), F.lit("\t"), (F.round(v).cast("bigint") if integers else v).cast("string")).alias("line"))


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(ord, hist, word, c)."""
    gram, value = F.split("value", "\t")[0], F.split("value", "\t")[1].cast("double")
    return spark.read.text(path).where("value != ''").select(F.size(F.split(gram, " ")).alias("ord"), head(gram).alias("hist"), tail(gram).alias("word"), value.alias("c"))


def write_symbols(symbols: DataFrame, path: str) -> None:
    symbols.orderBy("label").select(F.concat("symbol", F.lit("\t"), F.col("label").cast("string"))).coalesce(1).write.mode("overwrite").text(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    cells = F.split("value", "[\t ]+")
    return spark.read.text(path).where("value != ''").select(cells[0].alias("symbol"), cells[1].cast("bigint").alias("label"))


def read_arcs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Arcs (src, dst, ilabel, olabel, weight) and finals (state, weight) of a text automaton."""
    cells = F.split(F.trim("value"), "[\t ]+")
    rows = spark.read.text(path).where("trim(value) != ''").select(cells.alias("x"))
    arcs = rows.where(F.size("x") >= 4).select(*(F.col("x")[k].cast("int" if k < 2 else "string").alias(n) for k, n in enumerate(("src", "dst", "ilabel", "olabel"))), F.coalesce(F.get("x", F.lit(4)).cast("double"), F.lit(0.0)).alias("weight"))
    finals = rows.where(F.size("x") <= 2).select(F.col("x")[0].cast("int").alias("state"), F.coalesce(F.get("x", F.lit(1)).cast("double"), F.lit(0.0)).alias("weight"))
    return arcs, finals


def write_archive(rows: DataFrame, path: str, key: str = "key") -> None:
    """A keyed archive: Parquet sorted by key, so that a lookup prunes row groups."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def find(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("key") == key)
