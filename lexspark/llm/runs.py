"""Numbers of rows within their key, from partitions that are sorted by it.

A window over a key would put all rows of a frequent key into one task. Here rows are dealt
by ranges of key and order, so a frequent key covers many partitions; each task numbers the
rows of its own partition, and what lies before them is summed over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Runs:
    """Counts along the rows of one partition, batch after batch: the row, and the row within its key."""

    def __init__(self):
        self.row, self.run, self.key, self.begun = 0, 0, None, False

    def next(self, key: object) -> tuple[int, int]:
        self.run = self.run + 1 if self.begun and key == self.key else 1
        self.key, self.begun, self.row = key, True, self.row + 1
        return self.row, self.run


def ahead(rows: DataFrame, key: str) -> DataFrame:
    """(part, key, before): how many rows of a partition's first key lie in earlier partitions; a row for each partition at most.

    rows: part, row and run, as numbered by ``Runs`` in partitions dealt by ranges of ``key``.
    """
    ends = rows.groupBy("part").agg(F.min_by(key, "row").alias("first"), F.max_by(key, "row").alias("last"), F.max_by("run", "row").alias("n"))
    by_part = Window.orderBy("part")  # partitions, not rows
    run = ends.withColumn("new", F.coalesce(~F.lag("last").over(by_part).eqNullSafe(F.col("last")) | F.lag("last").over(by_part).isNull() & F.col("last").isNotNull(), F.lit(True)))
    run = run.withColumn("id", F.sum(F.col("new").cast("int")).over(by_part))
    upto = run.withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy("part")))
    found = upto.withColumn("before", F.when(F.lag("last").over(by_part).eqNullSafe(F.col("first")), F.lag("upto").over(by_part)))
    return found.where("before is not null").select("part", F.col("first").alias(key), "before")


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """rows with the number, from 1, of each row within its key."""
    before = ahead(rows, key).select(F.col("part").alias("_part"), F.col(key).alias("_key"), F.col("before").alias("_before"))
    same = (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(F.broadcast(before), same, "left").withColumn(out, F.col("run") + _or0("_before")).drop("_part", "_key", "_before")


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))
