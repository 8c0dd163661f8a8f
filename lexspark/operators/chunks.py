"""Counts of n-grams within chunks of texts, by arrays: what a task has to shuffle.

The words of a chunk are numbered, an n-gram is one integer made of its words' numbers, and
equal ones meet by sorting those. Strings are made for different n-grams alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.tokens import BOS, EOS

#: Bytes of text that are counted at a time (a longer text is one chunk), and rows of a batch that is given back.
CHUNK = 24 << 20
ROWS = 1 << 16
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 13, 12]] = True
NAMES = ["ord", "hist", "word", "c"]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The non-empty runs between blanks of all texts, one after the other, and how many each text has (null: none)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    raw = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))  # a blank after each
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=raw.offset + len(raw) + 1)[raw.offset :]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8, count=ends[-1])[ends[0] :] if len(raw) else np.zeros(0, np.uint8)
    blank = BLANK[data]
    last = np.flatnonzero(blank[1:] & ~blank[:-1])  # of each word
    before = np.cumsum(~blank)
    offsets = np.concatenate(([0], before[last])).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(last), pa.py_buffer(offsets), pa.py_buffer(data[~blank]))
    return made, np.diff(np.searchsorted(last, ends - ends[0], "left"))


def counted(texts: pa.Array, orders: list[int]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """(order, hist, word, c) of the different n-grams of each order in a chunk."""
    found, sizes = words(texts)
    coded = pc.dictionary_encode(pa.concat_arrays([pa.array([BOS, EOS], pa.large_string()), found]))
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[2:].astype(np.int64)
    lengths = sizes + 2
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    seq = np.full(len(place), -1, dtype=np.int64)
    seq[starts], seq[starts + lengths - 1] = 0, 1
    seq[seq < 0] = codes
    size = len(names)
    # key: the n-gram that ends at each place; once a further word doesn't fit in, keys are numbered anew.
    key, ranks, most = seq, [], size
    for n in range(1, max(orders) + 1):
        if n > 1:
            if most > (1 << 62) // size:
                again, key = np.unique(key, return_inverse=True)
                ranks.append((n - 1, again))
                most = len(again)
            key = np.concatenate(([0] * min(1, len(key)), key[:-1])) * size + seq
            most *= size
        if n not in orders:
            continue
        own = np.sort(key[place >= max(n - 1, 1)])
        first = np.flatnonzero(np.concatenate(([True] * min(1, len(own)), own[1:] != own[:-1])))
        c = np.diff(np.concatenate((first, [len(own)])))
        rest, parts, old = own[first], [], dict(ranks)
        for k in range(n, 0, -1):
            if k in old and k < n:
                rest = old[k][rest]
            parts.append(rest % size if k > 1 else rest)
            rest = rest // size
        by = [names.take(pa.array(x)) for x in reversed(parts)]
        hist = by[0] if n == 2 else pc.binary_join_element_wise(*by[:-1], pa.scalar(" ", pa.large_string())) if n > 1 else pa.array([""], pa.large_string()).take(pa.array(np.zeros(len(c), np.int64)))
        yield n, hist, by[-1], c


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.Array]:
    """Texts of many batches, or of a part of one, of about ``most`` bytes together."""
    held, size = [], 0
    for batch in batches:
        texts, at = batch.column(0), 0
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(texts):
            done = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + most - size, "right")))
            held.append(texts.slice(at, end - at))
            size += int(upto[end - 1]) - done
            at = end
            if size >= most or at < len(texts):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def counter(orders: list[int], most: int = CHUNK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of one column of texts: ord, hist, word and c, summed within each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, most):
            for n, hist, word, c in counted(texts, orders):
                for at in range(0, len(c), ROWS):
                    rows = [x.slice(at, ROWS).cast(pa.string()) for x in (hist, word)]
                    yield pa.record_batch([pa.array(np.full(len(rows[0]), n, dtype=np.int32)), *rows, pa.array(c[at : at + ROWS], pa.int64())], names=NAMES)

    return run
