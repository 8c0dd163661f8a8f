"""Term frequencies of each document joined to a table of all distinct terms.

The table of terms grows with the corpus, so it is joined by a shuffle on the term. Its
head, the ``head`` most frequent terms of at most ``head_bytes`` bytes each, is bounded by
these two numbers and is sent to the executors; documents resolve head terms where they
lie, so that the shuffle holds rare terms only and no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, materialise, text_bytes

HEAD = 100_000
HEAD_BYTES = 256
#: Distinct terms that a task holds before it writes its counts.
HELD = 400_000
SHARD_BYTES = 8 << 20
NAMES = ["row", "doc_id", "n_bytes", "n_terms", "term", "freq", "total", "n_known", "extra", "gram"]

#: Makes the splitter in the worker: text bytes (never None) to a list of terms.
Splitter = Callable[[], Callable[[bytes], list]]


def _counter(make: Splitter, text: bool):
    kind = pa.string() if text else pa.binary()

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), kind), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = make(), Counter()
        for batch in batches:
            for x in text_bytes(batch.column("text")):
                held.update(split(x or b""))
                if len(held) > HELD:
                    yield flush(held)
                    held.clear()
        yield flush(held)

    return count


def term_counts(rows: DataFrame, make: Splitter, text: bool = False) -> DataFrame:
    """(term, n): how often each distinct term occurs in the texts of the rows. text: terms are strings, else bytes."""
    kind = "string" if text else "binary"
    return rows.select("text").mapInArrow(_counter(make, text), f"term {kind}, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def head_of(table: DataFrame, value: str, head: int = HEAD, head_bytes: int = HEAD_BYTES) -> dict:
    """The most frequent terms with their values; at most head rows of head_bytes bytes reach the driver."""
    rows = table.where(F.octet_length("term") <= head_bytes).orderBy(F.desc("n"), "term").limit(head).select("term", value).toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def _summer(shared, make: Splitter, text: bool, extra):
    kind = pa.string() if text else pa.binary()
    long = pa.int64()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = make(), shared.value
        more = extra() if extra else None
        row = TaskContext.get().partitionId() << 33
        for batch in chunked(batches, "text", SHARD_BYTES):
            rows, docs, sizes, lengths, terms, freqs, totals, knowns, extras = ([] for _ in range(9))
            texts = [x or b"" for x in text_bytes(batch.column("text"))]
            found, begun = [None] * len(texts), row
            if more:
                sums, of, grams, times = more(texts)
                found = sums.tolist()
            for doc, x, e in zip(batch.column("doc_id").to_pylist(), texts, found, strict=True):
                freq = Counter(split(x))
                rare = {t: n for t, n in freq.items() if t not in known}
                n, n_rare, k = freq.total(), sum(rare.values()), len(rare)
                rows += [row] * (k + 1)
                docs += [doc, *[None] * k]
                sizes += [len(x), *[None] * k]
                lengths += [n, *[None] * k]
                terms += [None, *rare]
                freqs += [None, *rare.values()]
                totals += [float(sum(m * known[t] for t, m in freq.items() if t not in rare)), *[None] * k]
                knowns += [n - n_rare, *[None] * k]
                extras += [e, *[None] * k]
                row += 1
            yield pa.record_batch([pa.array(rows, long), pa.array(docs, long), pa.array(sizes, long), pa.array(lengths, long), pa.array(terms, kind), pa.array(freqs, long), pa.array(totals, pa.float64()), pa.array(knowns, long), pa.array(extras, pa.float64()), pa.nulls(len(rows), long)], names=NAMES)
            if more and len(of):
                own = {"row": pa.array(begun + of, long), "freq": pa.array(times, long), "gram": pa.array(grams, long)}
                kinds = {"term": kind, "total": pa.float64(), "extra": pa.float64()}
                yield pa.record_batch([own[c] if c in own else pa.nulls(len(of), kinds.get(c, long)) for c in NAMES], names=NAMES)

    return resolve


def weighted_sums(docs: DataFrame, make: Splitter, table: DataFrame, value: str, absent: float, text: bool = False, head: int = HEAD, extra: Callable[[], Callable[[list[bytes]], tuple]] | None = None, extra_table: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, n_terms, total, n_known for each row (doc_id, text): total sums, over its terms, frequency times value.

    A term that the table lacks has the value ``absent``; n_known counts the others. Rows
    are told apart by a number of their own, so ids may be null or repeated. extra: makes,
    in the worker, what gives one more sum for each text, and the grams that it lacks (text,
    gram, times), which are looked up in extra_table (gram, value); its column is ``extra``.
    """
    kind = "string" if text else "binary"
    shared = docs.sparkSession.sparkContext.broadcast(head_of(table, value, head))
    parts = materialise(docs.select("doc_id", "text").mapInArrow(_summer(shared, make, text, extra), f"row bigint, doc_id bigint, n_bytes bigint, n_terms bigint, term {kind}, freq bigint, total double, n_known bigint, extra double, gram bigint"), "frequencies")
    met = parts.where("term is not null").select("row", "term", "freq").join(table.select("term", F.col(value).cast("double").alias("value")), "term", "left")
    none = F.lit(None).cast("bigint")
    sums = met.select("row", none.alias("doc_id"), none.alias("n_bytes"), none.alias("n_terms"), (F.col("freq") * F.coalesce("value", F.lit(absent))).alias("total"), F.when(F.col("value").isNotNull(), F.col("freq")).otherwise(0).alias("n_known"), F.lit(None).cast("double").alias("extra"))
    sums = sums.unionByName(parts.where("n_terms is not null").select("row", "doc_id", "n_bytes", "n_terms", "total", "n_known", "extra"))
    if extra_table is not None:
        met = parts.where("gram is not null").select("row", "gram", "freq").join(extra_table, "gram")
        sums = sums.unionByName(met.select("row", (F.col("freq") * F.col("value")).alias("extra")), allowMissingColumns=True)
    return sums.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_bytes", "n_terms")), F.sum("extra").alias("extra"), F.sum("total").alias("total"), F.sum("n_known").cast("bigint").alias("n_known")).drop("row")
