"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Each shard has ``virtual`` points on a ring of 64-bit hashes; a point ends an arc, and the
documents whose hash lies in the arc belong to its shard. The hash is that of the text, so
equal texts start at one place. A shard takes as many rows as its share (counts differ by
one at most); what overflows continues clockwise to the next points with room. So balance
is guaranteed, and a change of the shards moves only rows near the changed arcs.

The driver sees one count for each arc, never a row: it walks the ring once and cuts each
arc's rows, by their number in the arc, into segments for shards. Rows are numbered
without a sort of a whole arc: an arc is dealt by ranges of the hash into lots of about
``lot`` rows, lots are counted, and only the rows of one lot are sorted together. Texts
with copies come before all others in their arc, equal ones next to each other, so that a
group is split only where a shard is full inside it. A text of more than ``lot`` rows gets
lots of its own, dealt by id, or by row number where there is no id or one alone.

Defined results. Null text: no bytes, hashed as the empty text. Null ids: dealt like
others. Repeated rows: each has its own slot. Ties in a lot: by hash, id, text sum and row
number. Empty table: no rows. Very long texts: one row like others. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_view, materialise

VIRTUAL = 64
LOT = 500
#: Slots of the ring by the highest bits of the hash, for looking an arc up without a search over all points.
SLOT_BITS = 12


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(point, shard) clockwise; as many rows as virtual nodes."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("point"))
    return sorted((r["point"], r["shard"]) for r in nodes.collect())


def segments(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first, end, shard, first slot): which of an arc's numbered rows a shard takes.

    First each arc gives its shard what it has room for, in the order of the ring; then
    the rest of each arc goes on clockwise to shards with room.
    """
    total = sum(counts)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    slot = [0] * shards
    taken = [0] * len(counts)
    out = []

    def give(arc: int, shard: int) -> None:
        n = min(counts[arc] - taken[arc], room[shard])
        if n:
            out.append((arc, taken[arc], taken[arc] + n, shard, slot[shard]))
            taken[arc] += n
            room[shard] -= n
            slot[shard] += n

    for arc, shard in enumerate(owners):
        give(arc, shard)
    for arc in range(len(counts)):
        at = arc
        while taken[arc] < counts[arc]:
            at = (at + 1) % len(counts)
            give(arc, owners[at])
    return out


def _arc(spark: SparkSession, rows: DataFrame, points: list[int]) -> DataFrame:
    """Adds the arc of each row's hash: the first point at or after it, clockwise."""
    size = 1 << (64 - SLOT_BITS)
    low = [-(1 << 63) + k * size for k in range(1 << SLOT_BITS)]
    before, at, table = 0, 0, []
    for k, start in enumerate(low):
        inside = []
        while at < len(points) and points[at] < start + size:
            inside.append(points[at])
            at += 1
        table.append((k, before, inside))
        before = at
    slots = spark.createDataFrame(table, "slot int, before int, inside array<bigint>")  # 2 ** SLOT_BITS rows, whatever the input
    slot = (F.shiftright("h", 64 - SLOT_BITS) + (1 << (SLOT_BITS - 1))).cast("int")
    passed = F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("h")))
    return rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").withColumn("arc", (passed % len(points)).cast("int")).drop("slot", "before", "inside")


def assign(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL, lot: int = LOT, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards hold numbers of rows that differ by one at most."""
    spark = docs.sparkSession
    view = docs_view(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    rows = view.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size") if size is None else size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    points = ring(spark, shards, virtual)
    rows = materialise(_arc(spark, rows, [p for p, _ in points]), "ring")

    found = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # a row for each virtual node
    counts = [found.get(k, 0) for k in range(len(points))]
    cuts = segments(counts, [s for _, s in points], shards)
    # Where an arc begins, as a number, and how wide it is; the first one goes round the end of the ring.
    begin = [float(points[k - 1][0]) - (2.0**64 if k == 0 else 0.0) for k in range(len(points))]
    arcs = spark.createDataFrame([(k, max(1, -(-n // lot)), begin[k], max(1.0, float(points[k][0]) - begin[k])) for k, n in enumerate(counts)], "arc int, lots bigint, begin double, wide double")
    plan = spark.createDataFrame(cuts or [(0, 0, 0, 0, 0)], "arc int, first bigint, end bigint, shard int, first_slot bigint")

    copies = materialise(rows.groupBy(F.col("h").alias("of")).agg(F.count("*").alias("copies"), (F.min("doc_id") == F.max("doc_id")).alias("one_id")).where("copies > 1"), "copies")  # two plain shuffles meet, so a hot text can be split
    dealt = rows.join(copies.hint("merge"), F.col("h") == F.col("of"), "left").drop("of").join(F.broadcast(arcs), "arc")
    ahead = F.col("h").cast("double") - F.col("begin")
    share = F.when(ahead > F.col("wide"), ahead - 2.0**64).otherwise(ahead) / F.col("wide")
    range_of = F.greatest(F.lit(0), F.least(F.floor(share * F.col("lots")), F.col("lots") - 1))
    hot = F.col("copies") > lot
    dealt = dealt.select(
        "doc_id", "size", "text_crc32", "h", "row", "arc",
        F.when(F.col("copies").isNull(), range_of + F.col("lots")).otherwise(range_of).alias("lot"),
        F.when(hot, F.col("h")).alias("hot"),
        F.when(hot, F.pmod(F.xxhash64(F.when(F.col("doc_id").isNull() | F.col("one_id"), F.col("row")).otherwise(F.col("doc_id"))), F.ceil(F.col("copies") / lot))).otherwise(0).alias("part"),
    )
    lots = dealt.groupBy("arc", "lot", "hot", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("arc").orderBy("lot", "hot", "part").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(F.col("arc").alias("a"), F.col("lot").alias("l"), F.col("hot").alias("x"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun"))
    inside = Window.partitionBy("arc", "lot", "hot", "part").orderBy("h", "doc_id", "text_crc32", "size", "row")
    numbered = dealt.withColumn("k", F.row_number().over(inside) - 1)
    same = (F.col("arc") == F.col("a")) & (F.col("lot") == F.col("l")) & F.col("hot").eqNullSafe(F.col("x")) & (F.col("part") == F.col("p"))
    numbered = numbered.join(lots, same).withColumn("number", F.col("k") + F.col("begun"))
    # Segments: no more than virtual nodes and shards together, so they are sent to all.
    placed = numbered.join(F.broadcast(plan.withColumnRenamed("arc", "of_arc")), (F.col("arc") == F.col("of_arc")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("number") - F.col("first")).alias("slot"))
