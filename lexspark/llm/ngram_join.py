"""Similarity self-join on word n-gram sets: MinHash banding, then exact sets.

The set of a text holds its runs of ``n`` words (word rule of ``common.words``); a text of
fewer words, but not none, has one n-gram of all its words. Two texts are linked if the
Jaccard similarity of their sets is ``threshold`` or more.

1. Texts of one set are one class; each class has one sketch of ``bands`` x ``rows``
   minimum hashes of 16 bits, and a hash for each band.
2. Band hashes are shuffled. Classes that share one form a bucket; large buckets are cut
   into blocks by number and bytes, and each pair of blocks is one unit of work, so that a
   hot bucket becomes many tasks.
3. A pair of a bucket is a candidate there if it shares no earlier band (so it counts
   once), if the sizes of its sets allow the threshold, and if the sketches agree in as
   many places as a pair at the threshold does but for a chance of ``(1 - recall) / 10``.
   Only sketches travel in this step. Chains of weak band mates end here: the cost follows
   the buckets, not the groups that they form together.
4. Texts travel only to units where they have a candidate, and candidates are verified on
   the full sets. A unit reports one row for each class with a link: the number of its
   links there and the least class it hangs on; pairs are never listed.
5. Links make the classes of near copies, as connected components.

Bands and rows are chosen for a target recall at the threshold. The number of links within
one dense group can only be had by comparing its different texts: that cost is quadratic
in the texts of a bucket that are really alike, in blocks, and no pair is left out.

Defined results. Null texts and texts without words: no links, a class of their own.
Repeated rows: copies. Null ids: linked like others; a class of null ids alone has a null
class id. Empty table: no rows. Ties: the smallest id names a class. Very long texts: whole.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, docs_view, materialise, sifted, text_bytes, words
from .components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
MOST_HASHES = 128
BLOCK = 192
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20
#: Words whose hashes a task holds.
HELD_WORDS = 100_000
NODE = struct.Struct(">BQQ")


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands reach the recall within the hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def least_agreement(hashes: int, threshold: float, miss: float) -> int:
    """The most places in which a pair at the threshold agrees, but for a chance of ``miss``."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > miss:
            return k
    return hashes


class _Hashes(dict):
    """64-bit hashes of words, for one task; starts anew when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_set(text: bytes | None, n: int = N, known: dict | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams."""
    known = _Hashes() if known is None else known
    w = np.fromiter(map(known.__getitem__, words(text)), dtype=np.uint64)
    size = max(1, len(w) - n + 1) if len(w) else 0
    h = np.full(size, len(w) if len(w) < n else n, dtype=np.uint64)
    for k in range(min(n, len(w))):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + size])
    return np.unique(h)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20_011).integers(0, 2**63, size=(2, count), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def sketch(grams: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the minimum of each hash function over the set."""
    low = np.full(len(factors[0]), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[at : at + 1024, None] * factors[0] + factors[1]).min(axis=0))
    return (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each line and band, different for each band number."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), 1))
    parts = sketches.reshape(len(sketches), bands, rows).astype(np.uint64)
    for k in range(rows):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return h.view(np.int64)


def _node(doc_id: int | None, row: int, key: bytes) -> bytes:
    """Orders rows by id, null last, then by row; of a class, the least one stands for it."""
    return NODE.pack(doc_id is None, 0 if doc_id is None else doc_id + (1 << 63), row) + key


def _number(node: Column, at: int) -> Column:
    """The eight bytes of a node from ``at`` on, as an unsigned number."""
    return F.conv(F.hex(F.substring(node, at, 8)), 16, 10).cast("decimal(20,0)")


def node_id(node: Column) -> Column:
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", (_number(node, 2) - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint"))


SIGNED = "row bigint, doc_id bigint, hash bigint, node binary, key binary, size bigint, grams bigint, sketch binary, bands array<bigint>"


def _signer(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, known = _factors(bands * rows), _Hashes()
        for batch in chunked(batches, "text", SHARD_BYTES):
            nodes, keys, sizes, counts, made = [], [], [], [], []
            done: dict[int, tuple] = {}
            for doc, row, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("hash").to_pylist(), text_bytes(batch.column("text")), strict=True):
                found = done.get(digest)
                if found is None or found[0] != text:
                    grams = ngram_set(text, n, known)
                    found = done[digest] = (text, hashlib.md5(grams.tobytes()).digest(), len(grams), sketch(grams, factors)) if len(grams) else (text, None, 0, None)
                nodes.append(_node(doc, row, found[1] or b""))
                keys.append(found[1])
                sizes.append(len(text or b""))
                counts.append(found[2])
                made.append(found[3])
            some = [x for x in made if x is not None]
            hashed = iter(band_hashes(np.stack(some), bands, rows)) if some else iter(())
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("hash"), pa.array(nodes, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([x if x is None else x.tobytes() for x in made], pa.binary()), pa.array([x if x is None else next(hashed) for x in made], pa.list_(pa.int64()))],
                names=["row", "doc_id", "hash", "node", "key", "size", "grams", "sketch", "bands"],
            )

    return sign


class Members:
    """The classes of one unit, by block and node: sketches, sizes of sets, copies."""

    def __init__(self, nodes: list[bytes], blocks: list[int], sketches: list[bytes], grams: list[int], copies: list[int], bands: int, rows: int):
        order = sorted(range(len(nodes)), key=lambda i: (blocks[i], nodes[i]))
        self.order = order
        self.nodes = [nodes[i] for i in order]
        self.blocks = np.array([blocks[i] for i in order])
        self.sketches = np.frombuffer(b"".join(sketches[i] for i in order), dtype=np.uint16).reshape(len(nodes), -1)
        self.bands = band_hashes(self.sketches, bands, rows)
        self.grams = np.array([grams[i] for i in order], dtype=np.int64)
        self.copies = np.array([copies[i] for i in order], dtype=np.int64)

    def candidates(self, low: int, high: int, band: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the unit's blocks that are to be verified in this band."""
        a = np.flatnonzero(self.blocks == low)
        b = a if low == high else np.flatnonzero(self.blocks == high)
        small = np.minimum(self.grams[a][:, None], self.grams[b][None, :])
        large = np.maximum(self.grams[a][:, None], self.grams[b][None, :])
        open_pairs = (small >= threshold * large - 1e-9) & (self.bands[a, band][:, None] == self.bands[b, band][None, :])
        if low == high:
            open_pairs &= a[:, None] < b[None, :]
        for k in range(band):
            open_pairs &= self.bands[a, k][:, None] != self.bands[b, k][None, :]
        i, j = np.nonzero(open_pairs)
        i, j = a[i], b[j]
        agree = np.zeros(len(i), dtype=np.int16)
        for at in range(0, len(i), 16_384):
            part = slice(at, at + 16_384)
            agree[part] = (self.sketches[i[part]] == self.sketches[j[part]]).sum(axis=1)
        return i[agree >= least], j[agree >= least]


def verified(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) reach the threshold, by the full sets."""
    size = np.array([len(g) for g in grams], dtype=np.int64)
    both = np.zeros(len(i), dtype=np.int64)
    if len(i) <= 8 * len(grams):
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            at = np.searchsorted(grams[y], grams[x])
            at[at == size[y]] = 0
            both[k] = (grams[y][at] == grams[x]).sum() if size[y] else 0
    else:  # a dense unit: products of 0/1 lines, over a slice of the n-grams at a time
        row = np.repeat(np.arange(len(grams), dtype=np.int32), size)
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        row, every = row[order], every[order]
        col = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]])).astype(np.int32)
        del every, order
        width = 2048
        shared = np.zeros((len(grams), len(grams)), dtype=np.float32)
        edges = np.searchsorted(col, np.arange(0, int(col[-1]) + 1 + width, width))
        for k in range(len(edges) - 1):
            part = np.zeros((len(grams), width), dtype=np.float32)
            part[row[edges[k] : edges[k + 1]], col[edges[k] : edges[k + 1]] - k * width] = 1
            shared += part @ part.T
        both = shared[i, j].astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n the first one that it hangs on by the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


UNIT = ["band", "bucket", "low", "high"]
MEMBER = ["block", "node", "key", "sketch", "grams", "copies", "doc_id", "hash"]
KINDS = "band int, bucket bigint, low int, high int, block int, node binary, key binary, sketch binary, grams bigint, copies bigint, doc_id bigint, hash bigint"


def _units(batches: Iterator[pa.RecordBatch], columns: list[str], take) -> Iterator[tuple[tuple, list]]:
    """Rows of sorted batches, unit by unit. take: what is held of a row, made as it is read."""
    unit, held = None, []
    for batch in batches:
        heads = zip(*(batch.column(c).to_pylist() for c in UNIT), strict=True)
        rest = zip(*(list(text_bytes(batch.column(c))) if c == "text" else batch.column(c).to_pylist() for c in columns), strict=True)
        for head, row in zip(heads, rest, strict=True):
            if head != unit:
                if held:
                    yield unit, held
                unit, held = head, []
            if (x := take(row)) is not None:
                held.append(x)
    if held:
        yield unit, held


def _chooser(bands: int, rows: int, threshold: float, least: int):
    """Keeps the members of each unit that have a candidate there."""
    schema = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(schema)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[*UNIT, *MEMBER])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (band, bucket, low, high), held in _units(batches, MEMBER, lambda row: row):
            if len(held) > 1:
                block, node, _, sketches, grams, copies, _, _ = zip(*held, strict=True)
                members = Members(node, block, sketches, grams, copies, bands, rows)
                i, j = members.candidates(low, high, band, threshold, least)
                out += [(band, bucket, low, high, *held[members.order[x]]) for x in np.union1d(i, j).tolist()]
            if len(out) >= 2_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return choose


def _verifier(n: int, bands: int, rows: int, threshold: float, least: int):
    schema = [pa.binary(), pa.binary(), pa.int64()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=["node", "near", "links"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, out = _Hashes(), set(), []

        def take(row: tuple):
            block, node, key, sketches, _, copies, text = row
            if node in seen:  # equal rows of one id and text
                return None
            grams = ngram_set(text, n, known)
            if hashlib.md5(grams.tobytes()).digest() != key:  # another text whose id and hash are the same
                return None
            seen.add(node)
            return block, node, sketches, len(grams), copies, grams

        def unit_of(unit: tuple, held: list) -> None:
            block, node, sketches, size, copies, grams = zip(*held, strict=True)
            members = Members(node, block, sketches, size, copies, bands, rows)
            i, j = members.candidates(unit[2], unit[3], unit[0], threshold, least)
            good = verified([grams[k] for k in members.order], i, j, threshold)
            i, j = i[good], j[good]
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, i, members.copies[j])
            np.add.at(links, j, members.copies[i])
            label = _labels(len(node), i, j)
            out.extend((members.nodes[x], members.nodes[label[x]], int(links[x])) for x in np.flatnonzero(links).tolist())

        for unit, held in _units(batches, ["block", "node", "key", "sketch", "grams", "copies", "text"], take):
            if len(held) > 1:
                unit_of(unit, held)
            seen.clear()
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        yield batch_of(out)

    return verify


def _linked(view: DataFrame, n: int, threshold: float, recall: float, most_hashes: int, block: int, block_bytes: int) -> DataFrame:
    """(row, doc_id, node, root, n_links) for each row (row, doc_id, text): its own node, and the least node of its class."""
    bands, rows = bands_for(threshold, recall, most_hashes)
    least = least_agreement(bands * rows, threshold, (1 - recall) / 10)
    view = view.withColumn("hash", F.xxhash64("text"))
    signed = materialise(view.select("row", "doc_id", "hash", "text").mapInArrow(_signer(n, bands, rows), SIGNED), "signatures")
    rep = F.min(F.struct("node", "doc_id", "hash")).alias("rep")
    classes = signed.where("key is not null").groupBy("key").agg(rep, F.count("*").alias("copies"), F.max("size").alias("size"), F.first("grams").alias("grams"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("key", "rep.node", "rep.doc_id", "rep.hash", "copies", "size", "grams", "sketch", "bands"), "classes")

    dealt = classes.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = dealt.groupBy("band", "bucket").agg(F.count("*").alias("met"), F.sum("size").alias("bytes")).where("met > 1")
    cut = F.greatest(F.ceil(F.col("met") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    shared = materialise(shared.select("band", "bucket", cut.alias("blocks")), "buckets")  # two plain shuffles meet, so a hot bucket can be split
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = dealt.join(shared.hint("merge"), ["band", "bucket"]).select("band", "bucket", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "blocks")
    members = members.select("band", "bucket", "key", "block", other).select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key")
    members = members.join(classes.drop("size", "bands").hint("merge"), "key").select(*UNIT, *MEMBER)
    members = members.repartition(*UNIT).sortWithinPartitions(*UNIT)
    needed = materialise(members.mapInArrow(_chooser(bands, rows, threshold, least), KINDS), "candidates")

    # Only texts with candidates travel, in one way at every size: a bit map of bounded size sifts the others out.
    texts, _ = sifted(view.select(F.col("doc_id").alias("id"), F.col("hash").alias("digest"), "text"), needed.select("hash"), "hash", "digest")
    whole = texts.join(needed.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("hash")))
    whole = whole.select(*UNIT, "block", "node", "key", "sketch", "grams", "copies", "text").repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
    found = materialise(whole.mapInArrow(_verifier(n, bands, rows, threshold, least), "node binary, near binary, links bigint"), "links")

    near = connected_components(found.select("node", "near"), "node", "near")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("key", "node", "copies").join(links, "node", "left").join(near, "node", "left")
    named = materialise(named.select(F.col("key").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    alone = signed.where("key is null").select("row", "doc_id", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("n_links"))
    return signed.where("key is not null").select("row", "doc_id", "node", "key").join(named, F.col("key") == F.col("of")).select("row", "doc_id", "node", "root", "n_links").unionByName(alone)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: a row for each document.

    class_id: the smallest id of all documents that hang together by links; copies are
    linked. n_links: the number of other documents that the document is linked to.
    """
    view = docs_view(docs, id_col, text_col).withColumn("row", F.lit(0).cast("bigint"))
    return _linked(view, n, threshold, recall, most_hashes, block, block_bytes).select("doc_id", node_id(F.col("root")).alias("class_id"), "n_links")


def deduplicated(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (nulls last).

    Rows are told apart by a number of their own, so that an id may be shared by different
    texts, and of equal rows one stays. Rows without words stay.
    """
    numbered = materialise(docs.withColumn("__lx_row", F.monotonically_increasing_id()), "numbered")
    view = numbered.select("__lx_row", F.col(id_col).alias("i"), F.col(text_col).alias("t")).select(F.col("__lx_row").alias("row"), F.col("i").cast("long").alias("doc_id"), F.col("t").cast("string").alias("text"))
    found = _linked(view, n, threshold, recall, most_hashes, block, block_bytes)
    gone = materialise(found.where("node != root").select(F.col("row").alias("__lx_gone")), "gone")
    hashed = numbered.withColumn("__lx_hash", F.xxhash64("__lx_row"))
    maybe, kept = sifted(hashed, gone.select(F.xxhash64("__lx_gone").alias("__lx_hash")), "__lx_hash", "__lx_hash")
    return maybe.join(gone.hint("merge"), F.col("__lx_row") == F.col("__lx_gone"), "left_anti").unionByName(kept).drop("__lx_hash", "__lx_row")
