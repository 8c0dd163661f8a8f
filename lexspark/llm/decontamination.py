"""Benchmark decontamination with an FM-index for each shard of the training documents.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. A shard is a slice of a partition, of bounded size. Its index
holds the runs of words that occur in the benchmark and are long enough for a window; all
other words end a run, since no window can hold them. The windows are searched backwards
through the wavelet ranks, all at once; their occurrences are located by sampled suffix
positions; overlapping and touching occurrences merge into spans of words.

The windows are made on the executors and dealt to blocks of about ``block_bytes`` bytes,
a long item to several. A block is collected, turned into numbers, sent to the executors
and let go before the next one; a task reads the documents once and holds one block at a
time. So any size of benchmark takes the same plan, and neither the driver nor a task
holds more than a block.

Defined results. Null and wordless texts: no words, no hit. Null ``doc_id``: the row is
kept. Benchmark rows with a null id or no words: no windows. Repeated items: each id
counts. Repeated documents: each row for itself. Empty tables: no rows, or no hits. Very
long texts: whole. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, docs_view, materialise, text_bytes, words
from .fm_index import FMIndex

WIDTH = 13
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20

SPANS = "array<struct<start:bigint,end:bigint>>"


class Windows:
    """The windows of a block as numbers, and the items of each window. pairs: (words, item)."""

    def __init__(self, pairs: Iterable[tuple[list[bytes], int]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[bytes, set[int]] = {}
        for window, item in pairs:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window], dtype=np.int32)
            found.setdefault(ids.tobytes(), set()).add(item)
        self.patterns = np.zeros((len(found), width), dtype=np.int32)
        for row, window in enumerate(found):
            self.patterns[row, width - len(window) // 4 :] = np.frombuffer(window, dtype=np.int32)
        self.lengths = np.array([len(x) // 4 for x in found], dtype=np.int64)
        self.items = np.array([y for x in found.values() for y in sorted(x)], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0


def windows_of(text: bytes | None, width: int) -> Iterator[list[bytes]]:
    w = words(text)
    for i in range(max(1, len(w) - width + 1) if w else 0):
        yield w[i : i + width]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] numbers; then those of start[1] ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def find(known: list[np.ndarray], windows: Windows) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Merged spans of words and items for each document of a shard. known: the benchmark's number of each word, else 0."""
    spans: list[list[tuple[int, int]]] = [[] for _ in known]
    items: list[list[int]] = [[] for _ in known]
    flat = np.concatenate([x for k in known for x in (k, [0])]) if known else np.zeros(0, dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([len(k) + 1 for k in known])]).astype(np.int64)
    inside = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    enough = end - start >= windows.shortest
    start, end = start[enough], end[enough]
    if not len(start) or not len(windows.lengths):
        return spans, items
    size = end - start + 1  # with the 0 behind it
    run_start = np.cumsum(size) - size
    index = FMIndex(flat[ranges(start, size)] * (np.arange(size.sum()) != np.repeat(run_start + size - 1, size)), run_start, len(windows.vocabulary))
    low, high = index.search(windows.patterns, windows.lengths)
    hit = np.flatnonzero(low < high)
    count = high[hit] - low[hit]
    if not len(hit):
        return spans, items
    window = np.repeat(hit, count)
    place = index.locate(ranges(low[hit], count))
    run = np.searchsorted(run_start, place, "right") - 1
    place = start[run] + place - run_start[run]
    doc = np.searchsorted(base, place, "right") - 1

    n_items = windows.first[window + 1] - windows.first[window]
    pairs = np.unique(np.stack([np.repeat(doc, n_items), windows.items[ranges(windows.first[window], n_items)]]), axis=1)
    for d, item in pairs.T.tolist():
        items[d].append(item)

    order = np.argsort(place, kind="stable")
    begin, reach = place[order], np.maximum.accumulate((place + windows.lengths[window])[order])
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])  # a document's last word and the next one's first are never neighbours
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(begin) - 1]])
    for d, s, e in zip(doc[order][fresh].tolist(), begin[fresh].tolist(), reach[last].tolist(), strict=True):
        spans[d].append((s - int(base[d]), e - int(base[d])))
    return spans, items


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def hits(texts: Iterable[bytes | None], blocks: list) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
    """Words, spans and items of each text of a shard. blocks: broadcasts of Windows, read one after the other."""
    split = [words(x) for x in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in split]
    items: list[set[int]] = [set() for _ in split]
    for block in blocks:
        windows: Windows = block.value
        number = windows.vocabulary.get
        for d, (s, i) in enumerate(zip(*find([np.fromiter((number(w, 0) for w in x), dtype=np.int64) for x in split], windows), strict=True)):
            spans[d] += s
            items[d].update(i)
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # it is read again from the executor's copy
    return [len(x) for x in split], [merged(x) if len(blocks) > 1 else x for x in spans], [sorted(x) for x in items]


def _searcher(blocks: list):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", SHARD_BYTES):
            n_words, spans, items = hits(text_bytes(batch.column("text")), blocks)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SCHEMA.field("spans").type), pa.array(items, SCHEMA.field("items").type)], schema=SCHEMA)

    return search


def _windower(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text")), strict=True):
                found = {b" ".join(w) for w in windows_of(text, width)}
                yield pa.record_batch([pa.array([item] * len(found), pa.int64()), pa.array(sorted(found), pa.binary())], names=["item", "window"])

    return make


def blocks_of(benchmark: DataFrame, width: int, block_bytes: int, item_col: str = "item_id") -> list:
    """Broadcasts of Windows, each of about block_bytes bytes of windows."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    pairs = materialise(bench.mapInArrow(_windower(width), "item bigint, window binary"), "windows")
    total = pairs.agg(F.coalesce(F.sum(F.octet_length("window") + 16), F.lit(0)).alias("n")).first()["n"]
    n = int(-(-total // block_bytes)) or 1
    out = []
    for k in range(n):
        mine = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == k).toArrow()
        rows = ((w.as_py().split(b" "), i.as_py()) for w, i in zip(mine.column("window"), mine.column("item"), strict=True))
        out.append(spark.sparkContext.broadcast(Windows(rows, width)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, spans (of word numbers, end excluded), items, contaminated.

    A document is contaminated if it has hit words and they are at least one in ``share``.
    """
    found = docs_view(docs).mapInArrow(_searcher(blocks_of(benchmark, width, block_bytes, item_col)), f"doc_id bigint, n_words bigint, spans {SPANS}, items array<bigint>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    for start, end in reversed(spans):
        text = text[: at[start][0]] + text[at[end - 1][1] :]
    return text


def _cleaner(blocks: list, share: int, text_col: str, cut: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text_col, SHARD_BYTES):
            n_words, spans, _ = hits(text_bytes(batch.column(text_col)), blocks)
            n_hit = [sum(e - s for s, e in x) for x in spans]
            bad = [n > 0 and share * n >= m for n, m in zip(n_hit, n_words, strict=True)]
            if not cut:
                yield batch.filter(pa.array([not x for x in bad], pa.bool_()))
            elif any(bad):
                at = batch.schema.get_field_index(text_col)
                texts = [without_spans(x.as_py(), s) if b else x.as_py() for x, s, b in zip(batch.column(text_col), spans, bad, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            else:
                yield batch

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, block_bytes: int = BLOCK_BYTES, text_col: str = "text", cut: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated; they are unchanged.

    cut: contaminated rows stay instead, without the words of their spans and what stands
    between those.
    """
    return docs.mapInArrow(_cleaner(blocks_of(benchmark, width, block_bytes), share, text_col, cut), docs.schema)
