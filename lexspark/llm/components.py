"""Connected components of an edge table, by alternating stars, in DataFrame operations alone.

A round replaces the neighbours of each node by edges to the least node in sight (large
stars, then small stars); the components end as stars around their least nodes. Each
round is written to the shared folder, and so are the least nodes before they are joined:
two plain shuffles meet then, so that the neighbours of a hot node can be split over many
tasks. Nothing is collected but a count and a checksum, and no node's neighbours meet in
one row. Tables of earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """edges: a > b. Large: neighbours beyond the node get its least; small: those before it do. With the tables it reads."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least, path = stored(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    met = seen.join(least.hint("merge"), F.col("u") == F.col("k"))
    if large:
        made = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return made.where("a > b").distinct(), [path]


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge between different nodes; root: the least node of its component.

    Nulls are no nodes; repeated edges and loops change nothing; an empty table gives none.
    """
    spark = edges.sparkSession
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, path = stored(both.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        stamp = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if stamp == before or not stamp[0]:
            break
        before = stamp
        wide, used = _star(now, True)
        wide, between = stored(wide, "edges")
        narrow, more = _star(wide, False)
        old, (now, path) = path, stored(narrow, "edges")
        discard(spark, old, between, *used, *more)
    else:
        raise RuntimeError("components have not settled")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
