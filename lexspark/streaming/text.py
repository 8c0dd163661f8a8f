"""Rules and counts on streams. An addition: rule application keeps no state, so it works on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import padded, tokens
from ..operators.counting import grams


def windowed_counts(stream: DataFrame, order: int = 2, text: str = "text", time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, ord, hist, word, c): n-grams of each time window; windows close when the watermark passes them."""
    rows = stream.withWatermark(time, late).select(time, F.explode(grams(padded(tokens(F.col(text))), order)).alias("g"))
    return rows.groupBy(F.window(time, window).alias("window"), F.col("g.ord").alias("ord"), F.col("g.hist").alias("hist"), F.col("g.word").alias("word")).agg(F.count("*").alias("c"))


def rewritten(stream: DataFrame, column: str, rule, out: str = "rewritten") -> DataFrame:
    from ..operators.rules import apply

    return apply(stream, column, rule, out)
