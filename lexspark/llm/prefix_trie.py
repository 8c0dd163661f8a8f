"""A trie of the turns that conversations begin with, by partition refinement.

All conversations start in one class, the root. A turn splits each class by what its
members say next; the new classes are the nodes one deeper. A class of one member retires:
the rest of its conversation is a chain of nodes with one child each, which is emitted from
its length alone, and is never grouped. Classes with more members stay active. Turns are
taken in blocks of 4, 8, 16, ... so that the rounds are few however deep copies agree; within
a block a class is named by a digest of its parent and the turn, so that one grouping splits
all classes of the block, and no class is ever gathered in a task.

Folding back needs no pass for each depth. A node is known by its smallest member, whose own
turns lead past all its ancestors. What a node adds to the sums of its subtrees is put on
the path of that member, summed along the path from its end, and then summed by class.

The ids of members that end at a node are hashed in order: tasks join the ids of their
range to chunks, and only chunks meet.

Defined results. Null roles and texts: empty. Turns with the same number: in the order of
role and text (their first 64 characters, then a hash); repeated rows are turns of their
own. Null turns: first. Null conversation ids: no conversation. Conversations without turns
(``lengths`` may list some): members of the root that end there. Very long texts: whole,
through their digest. Empty table: no nodes. Other columns, of any name: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, stored, text_bytes
from .runs import Runs, numbered

ROOT = bytes(16)
FIRST, MOST = 4, 4_096
CHUNK = 4_096


@dataclass
class Turns:
    turns: DataFrame  # conv, d (from 1), key, words
    lengths: DataFrame  # conv, length


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, runs = TaskContext.get().partitionId(), Runs()
    for batch in batches:
        convs = batch.column("conv").to_pylist()
        rows, keys, words = [], [], []
        for conv, role, text in zip(convs, text_bytes(batch.column("role")), text_bytes(batch.column("text")), strict=True):
            rows.append(runs.next(conv))
            keys.append(hashlib.sha256(len(role).to_bytes(8, "little") + role + text).digest()[:16])
            words.append(len(text.split()))
        long = pa.int64()
        yield pa.record_batch([pa.array(convs, long), pa.array([part] * len(convs), pa.int32()), pa.array([r for r, _ in rows], long), pa.array([r for _, r in rows], long), pa.array(keys, pa.binary()), pa.array(words, long)], names=["conv", "part", "row", "run", "key", "words"])


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Turns:
    """The turns in order, each as a digest of role and text and its number of words, and the length of every conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")
    order = ["conv", F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), "tie", "copy"]
    rows = rows.withColumns({"tie": F.xxhash64("role", "text"), "copy": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    made = materialise(dealt.mapInArrow(_number, "conv bigint, part int, row bigint, run bigint, key binary, words bigint"), "turns")
    found = numbered(made, "conv", "d").select("conv", F.col("d").cast("bigint").alias("d"), "key", "words")
    return Turns(found, materialise(found.groupBy("conv").agg(F.max("d").alias("length")), "lengths"))


def _chain(first: bool):
    """Rows sorted by conversation and depth: the class of each turn, from that of the marker row before the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cls = None, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for c, d, key, words in zip(*(batch.column(x).to_pylist() for x in ("conv", "d", "key", "words")), strict=True):
                if c != conv:
                    conv, cls = c, ROOT if first else None
                if words is None:
                    cls = key
                elif cls is not None:
                    parent, cls = cls, hashlib.sha256(cls + key).digest()[:16]
                    for to, x in zip(out, (c, d, cls, parent, words), strict=True):
                        to.append(x)
            conv_, d_, cls_, parent_, words_ = out
            yield pa.record_batch([pa.array(conv_, pa.int64()), pa.array(d_, pa.int64()), pa.array(cls_, pa.binary()), pa.array(parent_, pa.binary()), pa.array(words_, pa.int64())], names=["conv", "d", "cls", "parent", "words"])

    return run


def refine(found: Turns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes of several members (cls, conv, d, n, parent, words), the conversations that retired
    (conv, start, parent: the first class that they are alone in, and the class above it), and the
    paths of all members through those classes (conv, d, cls)."""
    lo, size = 1, FIRST
    active: DataFrame | None = None
    classes, gone, chains = [], [], []
    path = None
    while True:
        hi = lo + size - 1
        rows = found.turns.where(F.col("d").between(lo, hi)).select("conv", "d", "key", "words")
        if active is not None:
            rows = rows.unionByName(active.select("conv", F.lit(lo - 1).cast("bigint").alias("d"), F.col("cls").alias("key"), F.lit(None).cast("bigint").alias("words")))
        dealt = rows.repartition("conv").sortWithinPartitions("conv", "d")
        chain = materialise(dealt.mapInArrow(_chain(active is None), "conv bigint, d bigint, cls binary, parent binary, words bigint"), "chain")
        split = chain.groupBy("cls").agg(F.min("conv").alias("conv"), F.max("d").alias("d"), F.count("*").alias("n"), F.max("parent").alias("parent"), F.max("words").alias("words"))
        split = materialise(split, "classes")
        alone = materialise(split.where("n = 1").groupBy("conv").agg(F.min("d").alias("start"), F.min_by("parent", "d").alias("parent")), "retired")
        classes.append(split.where("n > 1"))
        gone.append(alone)
        chains.append(chain)
        ends = chain.where(F.col("d") == hi).select("conv", "cls").join(alone.select("conv"), "conv", "left_anti")
        if path is not None:
            old = path
        active, path = stored(ends, "active")
        if lo > 1:
            discard(chain.sparkSession, old)
        if active.isEmpty():
            break
        lo, size = hi + 1, min(2 * size, MOST)
    shared, retired, chain = classes[0], gone[0], chains[0]
    for a, b, c in zip(classes[1:], gone[1:], chains[1:], strict=True):
        shared, retired, chain = shared.unionByName(a), retired.unionByName(b), chain.unionByName(c)
    left = chain.select("conv", "d", "cls").join(retired.select("conv", "start").hint("merge"), "conv", "left").where("start is null or d < start")
    return shared, retired, materialise(left.select("conv", "d", "cls"), "paths")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and id: their ids, joined, some thousand at a time."""
    cls, first, ids = None, None, []

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([cls], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])], names=["cls", "first", "ids"])

    for batch in batches:
        for c, i in zip(batch.column("cls").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (c != cls or len(ids) == CHUNK):
                yield row()
                ids = []
            if not ids:
                cls, first = c, i
            ids.append(i)
    if ids:
        yield row()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order: the hash of all ids of a class; a chunk is held at a time."""
    cls, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([cls], pa.binary()), pa.array([digest.hexdigest()])], names=["cls", "ends_sha256"])

    for batch in batches:
        for c, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest is not None and c == cls:
                digest.update(b"," + ids.encode())
            else:
                if digest is not None:
                    yield row()
                cls, digest = c, hashlib.sha256(ids.encode())
    if digest is not None:
        yield row()


def ends(rows: DataFrame) -> DataFrame:
    """cls, ends_sha256: of the ids (column conv) of each class, ascending, with commas between."""
    chunks = rows.select("cls", "conv").repartitionByRange("cls", "conv").sortWithinPartitions("cls", "conv").mapInArrow(_chunks, "cls binary, first bigint, ids string")
    return chunks.repartition("cls").sortWithinPartitions("cls", "first").mapInArrow(_hashes, "cls binary, ends_sha256 string")


def trie(found: Turns) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    spark = found.turns.sparkSession
    lengths = found.lengths
    top = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    nodes = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not top["n"]:
        return spark.createDataFrame([], nodes)
    if top["n"] == 1:
        shared = spark.createDataFrame([], "cls binary, conv bigint, d bigint, n bigint, parent binary, words bigint")
        retired = lengths.where("length > 0").select("conv", F.lit(1).cast("bigint").alias("start"), F.lit(ROOT).alias("parent"))
        paths = spark.createDataFrame([], "conv bigint, d bigint, cls binary")
    else:
        shared, retired, paths = refine(found)

    under = shared.select("parent").unionByName(retired.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    under = materialise(under, "children")
    bare = shared.join(under.select(F.col("parent").alias("cls")), "cls", "left_anti")
    zero = F.lit(0).cast("bigint")
    added = (
        shared.where("n > 1 and words > 0").select("conv", "d", ((F.col("n") - 1) * F.col("words")).alias("w"), zero.alias("leaf"))
        .unionByName(bare.select("conv", "d", zero.alias("w"), F.lit(1).cast("bigint").alias("leaf")))
        .unionByName(retired.select("conv", (F.col("start") - 1).alias("d"), zero.alias("w"), F.lit(1).cast("bigint").alias("leaf")))
    )
    added = materialise(added.groupBy("conv", "d").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf")), "added")
    back = Window.partitionBy("conv").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda c: F.coalesce(F.sum(c).over(back), F.lit(0))
    folded = paths.join(added.hint("merge"), ["conv", "d"], "left").select("cls", upto("w").alias("w"), upto("leaf").alias("leaf"))
    folded = folded.groupBy("cls").agg(F.sum("w").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    ended = paths.join(lengths.select("conv", F.col("length").alias("d")).hint("merge"), ["conv", "d"], "left_semi").select("cls", "conv")
    ended = ended.unionByName(lengths.where("length = 0").select(F.lit(ROOT).alias("cls"), "conv"))
    hashed = materialise(ends(ended), "ends")

    none = hashlib.sha256(b"").hexdigest()
    above = shared.select(F.col("cls").alias("parent"), F.col("conv").alias("parent_conv_id"))
    deep = shared.where("d > 1").join(above.hint("merge"), "parent").unionByName(shared.where("d = 1").select(*shared.columns, F.lit(top["conv"]).alias("parent_conv_id")), allowMissingColumns=True)
    inner = deep.join(under.withColumnRenamed("parent", "cls"), "cls", "left").join(folded, "cls").join(hashed, "cls", "left")
    inner = inner.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

    met = retired.where("start > 1").join(above.hint("merge"), "parent").select("conv", "start", "parent_conv_id").unionByName(retired.where("start = 1").select("conv", "start", F.lit(top["conv"]).alias("parent_conv_id")))
    tails = met.join(lengths.hint("merge"), "conv").select("conv", "start", "parent_conv_id", "length", F.explode(F.sequence("start", "length", F.lit(CHUNK).cast("bigint"))).alias("from")).select("*", F.explode(F.sequence("from", F.least(F.col("from") + (CHUNK - 1), F.col("length")))).alias("depth"))
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("bigint")
    tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("parent_conv_id")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(none)).alias("ends_sha256"),
    )

    sums = added.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaf")).first()
    at_root = under.where(F.col("parent") == F.lit(ROOT)).first()
    end = hashed.where(F.col("cls") == F.lit(ROOT)).first()
    root = spark.createDataFrame([(top["conv"], 0, None, top["n"], at_root["n_children"] if at_root else 0, sums["leaf"] or 1, sums["w"], end["ends_sha256"] if end else none)], nodes)
    return root.unionByName(inner).unionByName(tails)


def rebuilt(found: Turns, group: int = 20, most: int = 4) -> Turns:
    """Conversations that begin as others do: conversation c gets the first h turns of c - c % group, then its own turns
    after its first h, where h is the checksum (crc32) of c in decimal, modulo ``most``."""
    convs = found.lengths.select("conv", "length", (F.col("conv") - F.col("conv") % group).alias("base"), F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).alias("h"))
    bases = found.lengths.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("length").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialise(convs.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    heads = found.turns.where((F.col("d") < most) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    begun = convs.where("m > 0").select("conv", "base", "m").join(heads, "base").where("d <= m").select("conv", "d", "key", "words")
    own = found.turns.join(convs.select("conv", "h", "m").hint("merge"), "conv").where("d > h").select("conv", (F.col("d") - F.col("h") + F.col("m")).alias("d"), "key", "words")
    return Turns(materialise(begun.unionByName(own), "rebuilt-turns"), convs.select("conv", "length"))
