"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings have grades 0 to K-1. One weight vector w over hashed text features is shared by
all grades, with ordered thresholds: P(grade > k) = sigmoid(w.x - b_k), b_0 < b_1 < ...
The expected grade is the sum of these tails; a document is kept if the tail above a
chosen grade is at least ``keep``.

The features of a text are its words (runs of letters and digits, lower-cased) and its
marks: the shape of each token (its first and last character classes, upper case, whether
it repeats the token before it). Each is hashed into ``2**bits`` places. A word counts as
present (0.5); the marks hold 1 + log(count), scaled to unit length. The weight of a place
is free only if a score test finds it tied to the grade (|z| of ``screen`` or more, in
``least`` ratings or more); others stay at 0, so that chance words don't decide.

It is fitted on a bounded sample, which is documented here: at most ``most_rows`` labelled
documents, those with the smallest hashes of their id and text, among texts of at most
``most_bytes`` bytes. Every document is scored in full.

Defined results. Null or empty text: no feature, scored by the thresholds alone. Several
labels for a document: each is a rating. Null labels or ids: no rating. No rating at all,
or one grade only: the thresholds alone decide from the grades seen; with none, the
expected grade is null and the document is kept. Other columns pass unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, short_batches, text_bytes, words

BITS = 18
MOST_ROWS, MOST_BYTES = 20_000, 1 << 20
SCREEN, LEAST = 5.0, 8
PRESENT = 0.5
KEEP = 0.5
SHARD_BYTES = 8 << 20
#: Entries that are summed at a time.
SLICE = 1 << 19

_runs = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff]+")
#: A mark, or a group of kinds, that repeats: four of a mark and two of a group stand for any more.
_marks = re.compile(rb"([^A-Za-z0-9])\1{3,}")
_groups = re.compile(rb"(.{2,8}?)\1{2,}", re.DOTALL)


def shape(token: bytes) -> bytes:
    """The kinds of characters of a whole token in turn; marks stand for themselves, and repeats are shortened."""
    out = []
    for run in _runs.findall(token):
        c = run[0]
        if 48 <= c < 58:
            out.append(b"0")
        elif c >= 128 or chr(c).isalpha():
            out.append(b"A" if len(run) > 1 and run.isupper() else b"a")
        else:
            out.append(_marks.sub(rb"\1\1\1\1", run))
    return _groups.sub(rb"\1\1", b"".join(out))


class Features:
    """Hashed places of words and marks, memoised for each process."""

    def __init__(self, bits: int, keep: int = 120_000):
        self.mask, self.keep = (1 << bits) - 1, keep
        self.places: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = self.places.get(word)
        if found is None:
            if len(self.places) >= self.keep:
                self.places.clear()
            found = self.places[word] = zlib.crc32(word) & self.mask
        return found

    def _shape(self, token: bytes) -> int:
        found = self.shapes.get(token)
        if found is None:
            if len(self.shapes) >= self.keep:
                self.shapes.clear()
            found = self.shapes[token] = zlib.crc32(b"\0" + shape(token)) & self.mask
        return found

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text; those of its words come first."""
        tokens = (text or b"").split()
        marks = Counter(map(self._shape, tokens))
        same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        if same:
            marks[zlib.crc32(b"\0again" + str(min(9, 10 * same // len(tokens))).encode()) & self.mask] += 1
        known = np.sort(np.fromiter(map(self._word, set(words(text))), dtype=np.int64))
        value = 1 + np.log(np.fromiter(marks.values(), dtype=np.float64, count=len(marks)))
        value /= np.sqrt((value**2).sum()) or 1
        return np.concatenate([known, np.fromiter(marks, dtype=np.int64, count=len(marks))]), np.concatenate([np.full(len(known), PRESENT), value])


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score, one column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def screened(col: np.ndarray, val: np.ndarray, row: np.ndarray, off: np.ndarray, size: int, screen: float = SCREEN) -> np.ndarray:
    """Which places a score test ties to the grade. off: each rating, less the mean; row: the rating of each entry."""
    seen, squares, together = np.zeros(size), np.zeros(size), np.zeros(size)
    for at in range(0, len(col), SLICE):
        part = slice(at, at + SLICE)
        v = val[part].astype(np.float64)
        seen += np.bincount(col[part], minlength=size)
        squares += np.bincount(col[part], weights=v**2, minlength=size)
        together += np.bincount(col[part], weights=v * off[row[part]], minlength=size)
    spread = np.sqrt((off[row] ** 2).mean()) if len(col) else 0.0
    z = together / np.maximum(spread * np.sqrt(squares), 1e-12)
    return (np.abs(z) >= screen) & (seen >= LEAST)


def fit(places: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, bits: int, top: int, **options) -> Model:
    """Fits ratings given one by one: the places and values of each."""
    n = len(grades)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in places])
    col, val = (np.concatenate(places), np.concatenate(values)) if n else (np.zeros(0, np.int64), np.zeros(0))
    return fitted(row, col, val, grades, bits, top, **options)


def fitted(row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, bits: int, top: int, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4, screen: float = SCREEN) -> Model:
    """Full-gradient ascent with a step of its own for each weight; thresholds stay ordered as a first one and positive gaps.

    row, col, val: the rating, place and value of each entry.
    """
    n = len(grades)
    free = screened(col, val, row, grades - grades.mean() if n else np.zeros(0), 1 << bits, screen)[col]
    row, val = row[free], val[free].astype(np.float64)
    used, col = np.unique(col[free], return_inverse=True)
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.array([((grades > k).sum() + 1) / (n + 2) for k in range(top)])
    b = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    weight = ((n / np.maximum(np.bincount(grades, minlength=top + 1), 1)) ** 0.25)[grades] if n else np.zeros(0)  # rare grades count a little more
    weight /= weight.mean() if n else 1.0
    first, gaps = b[0], np.log(np.maximum(np.diff(b), 1e-3))
    seen_b = np.full(top, 1e-8)
    for _ in range(rounds):
        b = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        tail = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col] * val, minlength=n)[:, None] - b[None, :], -40, 40)))
        # P(grade) is the difference of neighbouring tails; the slope of its logarithm in the score:
        ext = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        upper, lower = ext[np.arange(n), grades], ext[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) * weight / p, lower * (1 - lower) * weight / p
        slope = d_up - d_low
        g = np.bincount(col, weights=slope[row] * val, minlength=len(used)) / max(n, 1) - decay * w
        seen += g**2
        w += rate * g / np.sqrt(seen)
        gb = np.array([(-d_up[grades == k + 1].sum() + d_low[grades == k].sum()) for k in range(top)]) / max(n, 1)
        g_first, g_gaps = gb.sum(), np.array([gb[k:].sum() for k in range(1, top)]) * np.exp(gaps)
        step = np.concatenate([[g_first], g_gaps])
        seen_b += step**2
        step = 0.1 * step / np.sqrt(seen_b)
        first, gaps = first + step[0], gaps + step[1:]
    weights = np.zeros(1 << bits, dtype=np.float32)
    weights[used] = w
    return Model(weights, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]), bits)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ratings 0, 1, 2 from the two marks: a point for quality and a point for not being toxic."""
    both = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return labels.where(both).select(F.col(id_col).cast("long").alias("rated_id"), (F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, top: int = 2, bits: int = BITS, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on the labelled documents with the smallest hashes, most_rows at most. top: the highest grade.

    An id that many rows or ratings share counts for each pair of them, within the bound.
    """
    short_batches(docs.sparkSession)
    picked = ratings.where("rated_id is not null").orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("rated_id"), F.col(text_col).cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(bits)
        for batch in chunked(batches, "text", SHARD_BYTES):
            rows = [made.of(x) for x in text_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("grade"), pa.array([p.astype(np.int32) for p, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))], names=["grade", "places", "values"])

    # The rows of the sample are chosen by small hashes before any text is turned into features.
    chosen = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(picked), "rated_id").select("grade", "text", F.xxhash64("rated_id").alias("h"), F.xxhash64("text", "grade").alias("t"))
    last = chosen.select("h", "t").orderBy("h", "t").limit(most_rows).agg(F.max(F.struct("h", "t")).alias("x")).first()["x"]
    if last is None:
        return None
    within = (F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("t") <= last["t"]))
    rows = chosen.where(within).select("grade", "text").mapInArrow(features, "grade int, places array<int>, values array<float>").limit(most_rows).toArrow()
    grades = rows.column("grade").to_numpy()
    if not len(grades):
        return None
    rows = rows.combine_chunks()
    places, values = rows.column("places").chunk(0), rows.column("values").chunk(0)
    first = places.offsets.to_numpy()
    col, val = places.values.to_numpy(), values.values.to_numpy()
    sizes = np.diff(first)
    sums = [zlib.crc32(col[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    order = np.lexsort((sums, sizes, grades))  # rows come in any order: makes sums repeatable
    begin = np.cumsum(sizes[order]) - sizes[order]
    at = np.repeat(first[:-1][order] - begin, sizes[order]) + np.arange(int(sizes.sum()))
    return fitted(np.repeat(np.arange(len(grades), dtype=np.int32), sizes[order]), col[at], val[at], grades[order], bits, top)


def _scorer(shared, above: int, text_col: str, keep: float | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        made = Features(model.bits)
        for batch in chunked(batches, text_col, SHARD_BYTES):
            scores = np.array([(model.weights[p] * v).sum() for p, v in map(made.of, text_bytes(batch.column(text_col)))], dtype=np.float64)
            tails = model.tails(scores)
            if keep is not None:
                yield batch.filter(pa.array(tails[:, above] >= keep, pa.bool_()))
            else:
                yield pa.record_batch([batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, above])], names=["doc_id", "expected_grade", "tail"])

    return score


def score(docs: DataFrame, model: Model | None, above: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail = P(grade > above)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"))
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), above, "text", None), "doc_id bigint, expected_grade double, tail double")


def kept(tail: Column, keep: float = KEEP) -> Column:
    return F.coalesce(tail >= keep, F.lit(True))


def selected(docs: DataFrame, model: Model | None, above: int = 1, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose tail is at least ``keep``."""
    if model is None:
        return docs
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), above, text_col, keep), docs.schema)
