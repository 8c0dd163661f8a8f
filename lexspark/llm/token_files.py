"""Token ids in binary files, with a minimal perfect hash index from document keys to places.

A folder holds

* ``ids-*.bin``: raw ids, lowest byte first, 2 bytes each where the vocabulary has up to
  65 536 ids and 4 otherwise, documents in ascending order of their key, nothing between;
* ``keys-*.mph``: for each bucket of keys a minimal perfect hash (``perfect_hash``) and,
  by slot, a fingerprint of the key, the shard, the first id within it, the number of ids
  and the number of documents with the key;
* ``shards`` and ``buckets``: small Parquet tables that list those files. A task names its
  file by itself and only what the finished job returned is listed, so that a task that ran
  twice, or whose executor was lost, leaves at most an unlisted file.

Writing deals texts by ranges of the key; each task codes its own, in order, and streams
them out. Keys with their places are then dealt to buckets by hash, some 100 000 to one.
A lookup deals keys to their buckets, finds slots at once for a batch, checks fingerprints,
and deals the places to shards, where ids are read by their offset: constant work for a
key, whatever the corpus holds. A key that isn't there is taken for another with a chance
of 2**-32. Files are written and read by pyarrow's file systems (local or shared folders,
HDFS, S3, GCS), whatever the folder's scheme is.

Defined results. Null text: as the empty text, the end id alone. Repeated keys: each row is
kept, in the order of a hash of its text, and found by its occurrence; a frequent key covers several
tasks. Null keys: after all others. Empty table: a folder with no files. Very long texts:
whole. Other columns, of any name: ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_view, materialise, new_folder
from .perfect_hash import PerfectHash, fingerprints
from .pretokens import public_path, vocabulary
from .runs import Runs, numbered

END = 0
BUCKET = 100_000
#: Stands in for a null key, together with a mark in the other half of the hashed key.
NO_KEY = 1 << 62
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("copies", "<u8")])
PLACES = "key bigint, part int, row bigint, run bigint, offset bigint, n bigint"


def _whole(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its store, which a name without one takes from the cluster."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, path: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, runs, at, out = vocabulary(path), TaskContext.get().partitionId(), Runs(), 0, None
        store, root = _open(folder)
        end = np.array([END], dtype=f"<u{width}").tobytes()
        try:
            for batch in batches:
                if out is None:
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{root}/{name}")
                    yield _row(name, part)
                rows: list[list] = [[], [], [], [], []]
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = words.encode(text.as_py() or "")
                    if width == 2:
                        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    out.write(ids)
                    out.write(end)
                    n = len(ids) // width + 1
                    for to, x in zip(rows, (key, *runs.next(key), at, n), strict=True):
                        to.append(x)
                    at += n
                key, row, run, offset, n = (pa.array(x, pa.int64()) for x in rows)
                yield pa.record_batch([key, pa.array([part] * len(row), pa.int32()), row, run, offset, n, pa.nulls(len(row), pa.string())], names=["key", "part", "row", "run", "offset", "n", "file"])
        finally:
            if out is not None:
                out.close()

    return write


def _row(name: str, part: int) -> pa.RecordBatch:
    """The row that names a shard's file."""
    none = pa.nulls(1, pa.int64())
    return pa.record_batch([none, pa.array([part], pa.int32()), none, none, none, none, pa.array([name])], names=["key", "part", "row", "run", "offset", "n", "file"])


def _halves(key: pa.Array, occurrence: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers that are hashed for a key and its occurrence."""
    gone = ~key.is_valid().to_numpy(zero_copy_only=False)
    high = key.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    low = occurrence.to_numpy().astype(np.int64).view(np.uint64) | np.where(gone, np.uint64(NO_KEY), np.uint64(0))
    return high, low


def _indexer(folder: str):
    """Rows of a bucket meet in one task, one bucket after the other; each becomes a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: t.column(c).combine_chunks()
            high, low = _halves(one("key"), one("occurrence"))
            made = PerfectHash.build(high, low)
            slots = made.slots(high, low)
            records = np.zeros(len(slots), dtype=RECORD)
            records["print"][slots] = fingerprints(high, low)
            for name, column in (("shard", "part"), ("offset", "offset"), ("n", "n"), ("copies", "copies")):
                records[name][slots] = one(column).to_numpy()
            bucket = t.column("bucket")[0].as_py()
            name = f"keys-{bucket:06d}-{uuid.uuid4().hex}.mph"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(made.dump())
                out.write(records.tobytes())
            held.clear()
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([len(slots)], pa.int64())], names=["bucket", "file", "n"])

        for batch in batches:
            of = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[0].column("bucket")[0].as_py() != of[a]:
                        yield done()
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return write


def _bucket(key: str, occurrence: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key, occurrence), F.lit(buckets)).cast("int")


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> str:
    """Codes the texts into files in a folder (a new one in the shared folder, if none is named), which is returned."""
    spark = docs.sparkSession
    folder = _whole(spark, folder or new_folder(spark, "token-files"))
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    path = tokenizer or public_path()
    width = 2 if vocabulary(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    view = docs_view(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # Copies of a row may lie in any order; the row's own number lets ranges cut between them.
    order = [F.asc_nulls_last("doc_id"), F.col("text_hash"), F.col("copy")]
    dealt = view.withColumns({"text_hash": F.xxhash64("text"), "copy": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    places = materialise(dealt.mapInArrow(_writer(folder, path, width), PLACES + ", file string"), "places")
    rows = places.where("row is not null").drop("file")
    sizes = rows.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = places.where("file is not null").select("part", "file").join(sizes, "part").select("part", "file", F.lit(width).alias("width"), "ids", "docs", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("start"))
    shards.coalesce(1).write.parquet(f"{folder}/shards")

    copies = rows.where("run > 1").select("key").distinct().unionByName(_spanning(rows)).distinct()
    copies = rows.join(copies.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left_semi").groupBy("key").agg(F.count("*").alias("copies"))
    copies = copies.select(F.col("key").alias("of"), "copies")
    found = numbered(rows, "key", "occurrence").join(copies, F.col("key").eqNullSafe(F.col("of")), "left").drop("of")
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, -(-total // bucket))
    entries = found.select(_bucket("key", "occurrence", buckets).alias("bucket"), "key", "occurrence", "part", "offset", "n", F.coalesce("copies", F.lit(1)).alias("copies"))
    made = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_indexer(folder), "bucket int, file string, n bigint")
    made.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/buckets")
    return folder


def _spanning(rows: DataFrame) -> DataFrame:
    from .runs import ahead

    return ahead(rows, "key").select("key")


def _finder(folder: str):
    """Rows sorted by the file of their bucket: each file is loaded once and asked for whole batches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, index, records = None, None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if files[a] != name:
                    name = files[a]
                    with store.open_input_file(f"{root}/{name}") as f:
                        raw = f.read()
                    index, at = PerfectHash.load(raw)
                    records = np.frombuffer(raw, RECORD, len(index), at)
                part = batch.slice(a, b - a)
                high, low = _halves(part.column("key"), part.column("occurrence"))
                slots = index.slots(high, low)
                there = slots >= 0
                there[there] = records["print"][slots[there]] == fingerprints(high, low)[there]
                got, keep = records[slots[there]], pa.array(there)
                yield pa.record_batch([part.column("key").filter(keep), part.column("occurrence").filter(keep), *(pa.array(got[c].astype(np.int64)) for c in ("shard", "offset", "n", "copies"))], names=["key", "occurrence", "part", "offset", "n", "copies"])

    return find


def places(keys: DataFrame, folder: str) -> DataFrame:
    """key, occurrence, part, offset, n, copies: where the files hold each asked (key, occurrence); those that aren't there are left out."""
    spark = keys.sparkSession
    folder = _whole(spark, folder)
    buckets = spark.read.parquet(f"{folder}/buckets")
    first = buckets.first()
    many = first["buckets"] if first else 1
    asked = keys.select(F.col("key").cast("long").alias("key"), F.col("occurrence").cast("long").alias("occurrence")).withColumn("bucket", _bucket("key", "occurrence", many))
    named = asked.join(buckets.select("bucket", "file"), "bucket")
    return named.repartition("file").sortWithinPartitions("file").mapInArrow(_finder(folder), "key bigint, occurrence bigint, part bigint, offset bigint, n bigint, copies bigint")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, file = None, None
        for batch in batches:
            ids = []
            for f, width, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "offset", "n")), strict=True):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, store.open_input_file(f"{root}/{f}")
                raw = file.read_at(n * width, offset * width)
                if len(raw) != n * width:
                    raise ValueError(f"{f} ends before {n} ids at {offset}")
                ids.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                if sum(map(len, ids)) > 1 << 24:
                    yield _ids(batch.slice(0, len(ids)), ids)
                    batch, ids = batch.slice(len(ids)), []
            if ids:
                yield _ids(batch, ids)
        if file is not None:
            file.close()

    return read


def _ids(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([batch.column("key"), batch.column("occurrence"), batch.column("start"), batch.column("n"), pa.array(ids, pa.binary())], names=["key", "occurrence", "start", "n", "ids"])


READ = "key bigint, occurrence bigint, start bigint, n bigint, ids binary"


def _opened(found: DataFrame, folder: str) -> DataFrame:
    shards = found.sparkSession.read.parquet(f"{folder}/shards").select(F.col("part").alias("of"), "file", "width", F.col("start").alias("before"))
    rows = found.join(shards, F.col("part") == F.col("of")).select("key", "occurrence", "file", "width", "offset", "n", (F.col("before") + F.col("offset")).alias("start"))
    # By ranges of place: a large shard is read by several tasks, each from front to back.
    return rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """key, occurrence, start (ids of all documents before), n, ids (4 bytes each): the documents of (key, occurrence) pairs."""
    folder = _whole(keys.sparkSession, folder)
    return _opened(places(keys, folder), folder).mapInArrow(_reader(folder), READ)


def _every(keys: DataFrame, folder: str) -> DataFrame:
    """Where the files hold all documents of each of the keys: the first one says how many there are."""
    first = places(keys.select(F.col("key").cast("long").alias("key")).distinct().withColumn("occurrence", F.lit(1)), folder)
    first = materialise(first, "first-places")
    span = 4_096
    blocks = first.where("copies > 1").select("key", "copies", F.explode(F.sequence(F.lit(2), F.col("copies"), F.lit(span))).alias("a")).repartition("key", "a")
    more = blocks.select("key", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + (span - 1), F.col("copies")))).alias("occurrence"))
    return first.unionByName(places(more, folder))


def documents(keys: DataFrame, folder: str) -> DataFrame:
    """As ``lookup``, with every occurrence of each key."""
    folder = _whole(keys.sparkSession, folder)
    return _opened(_every(keys, folder), folder).mapInArrow(_reader(folder), READ)


def checksums(keys: DataFrame, folder: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document of the keys, read from the files; no ids leave the tasks that read them."""
    folder = _whole(keys.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _reader(folder)(batches):
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("key"), batch.column("start"), batch.column("n"), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return _opened(_every(keys, folder), folder).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """part, file, width, ids, docs, start of each file of ids."""
    return spark.read.parquet(f"{folder}/shards")
