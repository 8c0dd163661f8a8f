"""LM scoring by a probabilistic suffix tree over the bytes of a normalised text.

A text is normalised to its words (A-Z lower-cased, no blanks inside), joined by one space
and closed by one end symbol, a line feed; the model gives a probability to that string,
byte by byte. Before the text stand end symbols.

Learning counts every gram of ``depth`` + 1 bytes over all training texts; counts of
shorter contexts are sums of these. A context is kept if it was met twice or more and its
next-symbol distribution diverges from that of its suffix: the count times the divergence
(in nats) must reach ``gain``. With a context its suffixes are kept. The tree is a table
that grows with the corpus; gains are computed by joins on the executors.

Smoothing: a context with count c and q kept successors gives a successor n / (c + q), and
the rest of its mass, times their probability there, to the symbols of its suffix. The
root adds 0.5 to the count of each of 256 bytes.

Scoring: the probability of a byte depends on its gram alone, so it is computed once for
each distinct gram, order by order, by joins with the tree. The ``head`` most frequent
grams are sent to the executors, which sum them where texts lie; all other grams of a text
are joined by a shuffle.

Defined results. Null text: as the empty text, an end symbol alone. Null ids: learned from,
not held out. Repeated rows: each scored, each learned from. Nothing to learn from: all
256 bytes alike, and base counts of 0. Empty table: no rows. Very long texts: scored
whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunked, docs_view, materialise, text_bytes
from .terms import term_counts, weighted_sums

DEPTH = 5
GAIN = 10.0
#: Grams sent to the executors, at most; the others are joined.
HEAD_GRAMS = 1 << 20
SLOT_BITS = 22
SHARD_BYTES = 8 << 20
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words without blanks, A-Z lower-cased, and one end."""
    return [*text.translate(LOWER).split(), END]


def _make_tokens() -> Callable[[bytes], list[bytes]]:
    return tokens


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split()) + END


def _positions(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of depth + 1 bytes, as a number, that ends at each byte of the texts; and how many each text has."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    lead = END * depth
    a = np.frombuffer(b"".join(lead + x for x in texts) + lead, dtype=np.uint8)
    gram = np.zeros(len(a) - depth, dtype=np.int64)
    for k in range(depth + 1):
        gram <<= 8
        gram |= a[k : len(a) - depth + k]
    text = np.ones(len(gram), dtype=bool)
    ends = np.cumsum(size + depth)
    for k in range(1, depth + 1):
        text[ends - k] = False  # these end in the bytes before the next text
    return gram[text], size


def _grams(depth: int):
    """Counts of all grams of depth + 1 bytes, each as a number: n in what is learned from, met in all texts."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        gram, n, met = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, n, met = gram[order], n[order], met[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first), np.add.reduceat(met, first)

    def batch_of(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in found], names=["gram", "n", "met"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in chunked(batches, "text", SHARD_BYTES):
            sides: tuple[list[bytes], list[bytes]] = [], []
            for x, out in zip(text_bytes(batch.column("text")), batch.column("held_out").to_pylist(), strict=True):
                sides[out].append(normalised(x or b""))
            for out, texts in enumerate(sides):
                if texts:
                    gram, met = np.unique(_positions(texts, depth)[0], return_counts=True)
                    n = np.where((gram & 0xFFFF) == 0x0A0A, 0, met) if not out else np.zeros_like(met)  # an empty text's end isn't learned
                    held.append((gram, n, met))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held = [merged(held)]
                if len(held[0][0]) > 1_500_000:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(merged(held))

    return count


def _position(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each is, and whether it is there."""
    at = np.searchsorted(where, what)
    there = at < len(where)
    there[there] = where[at[there]] == what[there]
    return np.where(there, at, 0), there


class Head:
    """Values of the most frequent grams: a table of slots, and a sorted list of those whose slot was taken."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.key, self.value = np.full(1 << SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << SLOT_BITS)
        slot = self.slot(gram)
        self.key[slot], self.value[slot] = gram, value
        more = self.key[slot] != gram
        order = np.argsort(gram[more])
        self.more, self.more_value = gram[more][order], value[more][order]

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each, 0 if it isn't here; and where those are that aren't."""
        slot = self.slot(gram)
        there = self.key[slot] == gram
        value = np.where(there, self.value[slot], 0.0)
        left = np.flatnonzero(~there)
        if len(self.more) and len(left):
            at, there = _position(self.more, gram[left])
            value[left[there]] = self.more_value[at[there]]
            left = left[~there]
        return value, left


_built: dict[str, Head] = {}


def _score_maker(shared, name: str, depth: int):
    def make() -> Callable[[list[bytes]], tuple[np.ndarray, ...]]:
        if name not in _built:
            _built.clear()
            _built[name] = Head(*shared.value)
        head = _built[name]

        def sums(texts: list[bytes]) -> tuple[np.ndarray, ...]:
            gram, size = _positions([normalised(x) for x in texts], depth)
            value, left = head.find(gram)
            doc = np.repeat(np.arange(len(texts)), size)
            total = np.bincount(doc, weights=value, minlength=len(texts))
            doc, gram = doc[left], gram[left]
            order = np.lexsort((gram, doc))
            doc, gram = doc[order], gram[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
            return total, doc[first], gram[first], np.diff(np.append(first, len(doc)))

        return sums

    return make


def grown(docs: DataFrame, depth: int = DEPTH, least: float = 0.0, gain: float = GAIN) -> tuple[DataFrame, DataFrame, int]:
    """The tree of the texts of docs (columns text and held_out, which says what isn't learned from).

    (k, context, gram, n, met, count, q) for each gram of k + 1 bytes in all texts: its
    counts, and the count and the number of successors of its context; (k, context) of
    the kept contexts; and the number of positions learned from.
    """
    counted = docs.select("text", "held_out").mapInArrow(_grams(depth), "gram bigint, n bigint, met bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    table = materialise(counted, "grams")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(_mask(k + 1))).alias("gram")) for k in range(depth + 1)))).alias("x")
    every = table.select("n", "met", orders).groupBy("x.k", "x.gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met")).withColumn("context", F.shiftright("gram", 8))
    successors = Window.partitionBy("k", "context")  # 256 at most
    levels = materialise(every.withColumn("count", F.sum("n").over(successors)).withColumn("q", F.count_if(F.col("n") > 0).over(successors)), "levels")

    own = levels.where((F.col("n") > 0) & (F.col("k") > 0) & (F.col("count") >= max(2, int(total * least))))
    own = own.withColumn("below", F.col("k") - 1).withColumn("suffix", F.expr("gram & (shiftleft(1L, 8 * k) - 1)"))
    short = levels.where((F.col("n") > 0) & (F.col("k") < depth)).select(F.col("k").alias("below"), F.col("gram").alias("suffix"), (F.col("n") / F.col("count")).alias("chance"))
    value = F.sum(F.col("n") * F.log(F.col("n") / F.col("count") / F.col("chance")))
    passed = own.join(short, ["below", "suffix"]).groupBy("k", "context").agg(value.alias("gain")).where(F.col("gain") >= gain)
    shorter = F.explode(F.transform(F.sequence(F.lit(1), "k"), lambda j: F.struct(j.alias("k"), F.col("context").bitwiseAND(F.element_at(F.array(*(F.lit(_mask(i)) for i in range(1, depth + 1))), j)).alias("context")))).alias("x")
    return levels, materialise(passed.select(shorter).select("x.k", "x.context").distinct(), "contexts"), total


def valued(levels: DataFrame, kept: DataFrame, total: int, depth: int) -> DataFrame:
    """(gram, met, value): log10 of the probability of the last byte after the others, for each gram of depth + 1 bytes."""
    p = levels.where("k = 0").select("gram", "met", ((F.col("n") + 0.5) / F.lit(total + 128)).alias("p"))
    for k in range(1, depth + 1):
        own = levels.where(F.col("k") == k).join(kept.where(F.col("k") == k).select("context", F.lit(True).alias("kept")), "context", "left")
        own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(k)))).join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        seen = (F.col("n") + F.col("q") * F.col("below")) / (F.col("count") + F.col("q"))
        p = own.select("gram", "met", F.when(F.col("kept"), seen).otherwise(F.col("below")).alias("p"))
    return p.select("gram", "met", F.log10("p").alias("value"))


def head_grams(values: DataFrame, head: int = HEAD_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams with their values, ``head`` at most."""
    band = F.floor(4 * F.log2("met"))
    room, least = head, None
    for r in sorted(values.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 4 rows for each doubling of a count
        room -= r["n"]
        if room < 0:
            break
        least = r["band"]
    rows = values.where(band >= least if least is not None else F.lit(False)).select("gram", "value").toArrow()
    return rows.column("gram").to_numpy(), rows.column("value").to_numpy()


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gain: float = GAIN, head: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from what isn't held out."""
    view = docs_view(docs, id_col, text_col)
    train = view.where(~held_out(F.col("doc_id")))
    counts = materialise(term_counts(train, _make_tokens), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    below = n + 0.5 * (v + 1)
    levels, kept, total = grown(view.withColumn("held_out", held_out(F.col("doc_id"))), depth, gain=gain)
    values = materialise(valued(levels, kept, total, depth), "values")
    shared = docs.sparkSession.sparkContext.broadcast(head_grams(values, head))
    table = counts.withColumn("value", F.log10((F.col("n") + 0.5) / F.lit(below)))
    more = _score_maker(shared, uuid.uuid4().hex, depth)
    sums = weighted_sums(view, _make_tokens, table, "value", float(np.log10(0.5 / below)), extra=more, extra_table=values.select("gram", "value"))
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n_terms").alias("n_tokens"), "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("total").alias("base_score"), F.col("extra").alias("score"))
