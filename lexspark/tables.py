"""Intermediate tables in the folder that the driver and all executors share.

A table that several later plans read is written once, as Parquet: a lost executor costs a
re-read and no recomputation from the first input.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where Spark runs in one process, as in tests, a temporary one is made if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """df written and read back, which cuts its lineage; and its path. by: a column whose values get folders of their own, which a filter on it skips."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexspark/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    made(path)
    _free(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


#: Fixed value: bytes of a table from which the shuffles that made it are worth a collection of garbage.
LARGE = 16 << 20


def _free(spark: SparkSession, path: str) -> None:
    """Has Spark delete the shuffle files of plans that are done: it does once the driver collects what refers to them, by itself every half hour."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() >= LARGE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def made(path: str) -> None:
    """Has ``cleanup`` delete a path."""
    _made.append(path)


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    return stored(df, name, by)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _made:
            _made.remove(name)


def cleanup(spark: SparkSession) -> None:
    """Deletes every table that this driver's operators wrote; results that still read them end."""
    discard(spark, *list(_made))
