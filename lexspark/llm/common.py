"""Shared pieces: tables in the shared folder, and byte-level text handling.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``.
They are ordinary Parquet, so a lost executor costs a re-read, never a recomputation
from the first input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..tables import cleanup, discard, shared_dir

__all__ = ["cleanup", "discard", "shared_dir"]  # from the core, for the operators here

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where the session leaves Spark's default.
SHORT = "1000"


def short_batches(spark: SparkSession) -> None:
    """Fewer rows in a batch than Spark's default: texts are long, and a batch is held several times over.

    A plan takes the setting when it runs, which may be after the operator has returned, so
    it is left in place. A session that sets its own number keeps it.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, SHORT)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path, so that the table can be dropped once later ones have taken its place."""
    short_batches(df.sparkSession)
    return tables.stored(df, name)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for files that tasks write; ``cleanup`` deletes it."""
    path = f"{shared_dir(spark)}/lexspark/{name}-{uuid.uuid4().hex}"
    tables.made(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Byte maps. Bytes of 128 and more are parts of letters outside ASCII and stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lower-cased and all ASCII but letters and digits made a space: splitting gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORDS = bytes(LOWER[c] if c >= 128 or chr(LOWER[c]).isalnum() else 32 for c in range(256))
#: Control characters that bytes.split() takes as blanks are \t\n\v\f\r and the space: the words [^\x20\x09-\x0D]+.
BLANKS = b" \t\n\x0b\x0c\r"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(WORDS).split() if text else []


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 of each text of an Arrow string column, without decoding it to str."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.cast(pa.large_binary() if wide else pa.binary())
    return (x.as_py() for x in raw)


def chunked(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each hold about ``most`` bytes; no row is cut or lost."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


LEAST_BITS, MOST_BITS = 18, 26


def marks_table(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bit map of a column of 64-bit hashes as a table (word, mark), and its bits: 2**MOST_BITS at most, whatever the number of rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * rows.count()).bit_length()))
    place = F.shiftright(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    return rows.groupBy(place.alias("__lx_word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{key}` & 63L as int)))").alias("__lx_mark")), bits


def marks(rows: DataFrame, key: str) -> np.ndarray:
    """The same bit map as words of 64 bits, for Python tasks."""
    table, bits = marks_table(rows, key)
    found = table.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found.column("__lx_word").to_numpy()] = found.column("__lx_mark").to_numpy().view(np.uint64)
    return out


def marked(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those that were marked; no marked one is missed."""
    low = keys & (len(words) * 64 - 1)
    return (words[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def sifted(rows: DataFrame, marked_rows: DataFrame, marked_key: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash in ``key`` may be among marked_rows, and those whose hash surely isn't.

    Only the former need a join with what was marked, so that only they are shuffled. What
    is broadcast is the bit map, 2**20 rows of two numbers at most.
    """
    table, bits = marks_table(marked_rows, marked_key)
    word = F.shiftright(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    with_mark = rows.join(F.broadcast(table), word == F.col("__lx_word"), "left")
    hit = F.coalesce(F.expr(f"shiftright(__lx_mark, cast(`{key}` & 63L as int)) & 1L") == 1, F.lit(False))
    return with_mark.where(hit).drop("__lx_word", "__lx_mark"), with_mark.where(~hit).drop("__lx_word", "__lx_mark")
