"""The corpus pipeline: each stage takes all rows that the one before it kept.

Every stage is written as Parquet and read again as the next one's documents. All but the
last return the columns of ``documents``, and any columns that the table has besides.

Defined results. Null and empty texts: graded by the thresholds alone, no lines to drop,
no copies of each other, not contaminated, packed as an end of text. Very long texts:
whole in every stage. Repeated rows: one stays. Ids that different texts share: each row
for itself; null ids: like others, after all ids. Ties: the smallest id, then the first
row. Columns whose names operators use inside: kept apart. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import materialise, table
from lexspark.llm.decontamination import decontaminated
from lexspark.llm.line_templates import cleaned
from lexspark.llm.ngram_join import deduplicated
from lexspark.llm.packing import pack
from lexspark.llm.quality import graded, selected, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose chance of the top grade (of quality and not toxic) is below one half."""
    return selected(docs, train(docs, graded(table(spark, sf_dir, "labels"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; n_chars follows the text; a document that loses all its lines goes."""
    found = cleaned(docs).where("__lx_dropped = 0 or __lx_dropped < __lx_lines")
    n_chars = F.when(F.col("__lx_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that hang together by n-gram similarity, the one with the smallest id stays."""
    return deduplicated(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go; all others stay as they are."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The trained classifier can't be expressed in SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
