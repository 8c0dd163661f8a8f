"""Token counts: pieces are counted once for each distinct pre-token of the corpus.

1. Pre-tokens are counted over all texts; each distinct one is coded once and only the
   number of its ids is kept.
2. That table is joined to the pre-token frequencies of each document, and the products
   are summed. No document's ids are made.

Defined results. Null text: as the empty text, no tokens. Strings of special tokens count
as the library does by default, as one token each. Null or repeated ids: each row for
itself, by a number of its own. Very long texts: no limit. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_view, materialise
from .pretokens import public_path, vocabulary
from .terms import term_counts, weighted_sums

LIMIT = 1024


def _splitter(path: str):
    def make():
        split = vocabulary(path).split
        return lambda text: split(text.decode())

    return make


def _sizer(path: str):
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(path).count
        for batch in batches:
            yield pa.record_batch([batch.column("term"), batch.column("n"), pa.array(map(count, batch.column("term").to_pylist()), pa.int64())], names=["term", "n", "pieces"])

    return size


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = tokenizer or public_path()
    view = docs_view(docs, id_col, text_col)
    table = materialise(term_counts(view, _splitter(path), text=True).mapInArrow(_sizer(path), "term string, n bigint, pieces bigint"), "pretokens")
    sums = weighted_sums(view, _splitter(path), table, "pieces", 0.0, text=True)
    n = F.col("total").cast("bigint")
    return sums.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
