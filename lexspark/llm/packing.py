"""Best-fit packing with swap-based local search, planned on the counts of each length.

A piece's place depends on its length alone, so the driver plans with at most
``capacity`` counts, whatever the number of documents: bins of one content are a group
with a count, and best fit, exchanges and moves act on whole groups. Executors number the
pieces of each length and look their place up in the plan.

Best fit takes the lengths from the longest down and puts each piece into the fullest bin
that holds it. The local search then takes pairs of underfull bins and moves a piece, or
exchanges one for one, two for one or one for two, if that fills the fuller bin further
(so the sum of squared fills grows), until the emptier bins run out, the least possible
number of bins is met or no step helps; it has no limit of steps.

Best fit leaves at most a few groups for each length, of any number of bins. The search
takes them by levels: a group of n bins gives each level a digit of n to the base 8, and a
level searches that many bins, each of which stands for 8**level bins with one content. So
a level has at most 7 bins of each group, whatever the number of documents; the number of levels
grows with its logarithm, and each level is a task of its own.

Defined results. Null text: as the empty text, one piece of the end id alone. Repeated
documents and null ids: each row is packed. Empty table: no rows. Very long texts are cut
into full pieces, the first of which may be shorter. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_view, materialise
from .pretokens import public_path, vocabulary

CAPACITY = 2048
#: A level of the search has fewer bins of each content than this.
BASE = 8
END = b"\0\0\0\0"

Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a bin), ...) and the number of such bins


def _with(content: tuple[tuple[int, int], ...], changes: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    held = Counter(dict(content))
    for length, n in changes:
        held[length] += n
    return tuple(sorted(((k, n) for k, n in held.items() if n), reverse=True))


def _fill(content: tuple[tuple[int, int], ...]) -> int:
    return sum(k * n for k, n in content)


class Bins:
    """Groups of bins by content, found by the room they have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, Counter] = {}
        self.rooms: list[int] = []

    def add(self, content: tuple[tuple[int, int], ...], n: int) -> None:
        if n and content:
            room = self.capacity - _fill(content)
            if room not in self.by_room:
                self.by_room[room] = Counter()
                insort(self.rooms, room)
            self.by_room[room][content] += n

    def take(self, content: tuple[tuple[int, int], ...], n: int) -> None:
        room = self.capacity - _fill(content)
        held = self.by_room[room]
        held[content] -= n
        if not held[content]:
            del held[content]
        if not held:
            del self.by_room[room]
            self.rooms.remove(room)

    def groups(self) -> list[Group]:
        return [(c, n) for room in self.rooms for c, n in sorted(self.by_room[room].items())]

    def total(self) -> int:
        return sum(sum(x.values()) for x in self.by_room.values())


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """The longest pieces first, each into the fullest bin that holds it."""
    bins = Bins(capacity)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(bins.rooms, length)
            if at < len(bins.rooms):
                room = bins.rooms[at]
                content, n = max(bins.by_room[room].items())
                each = room // length
                used = min(n, left // each)
                if used:
                    bins.take(content, used)
                    bins.add(_with(content, [(length, each)]), used)
                    left -= used * each
                else:
                    bins.take(content, 1)
                    bins.add(_with(content, [(length, left)]), 1)
                    left = 0
            else:
                each = capacity // length
                bins.add(((length, each),), left // each)
                bins.add(((length, left % each),) if left % each else (), 1)
                left = 0
    return bins


def _options(content: tuple[tuple[int, int], ...]) -> dict[int, tuple[int, ...]]:
    """What may leave a bin: nothing, one piece or two, by their length together."""
    found: dict[int, tuple[int, ...]] = {0: ()}
    lengths = [k for k, _ in content]
    for k in lengths:
        found.setdefault(k, (k,))
    for i, (a, n) in enumerate(content):
        for b in ([a] if n > 1 else []) + lengths[i + 1 :]:
            found.setdefault(a + b, (a, b))
    return found


def best_step(full: tuple[tuple[int, int], ...], low: tuple[tuple[int, int], ...], capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """(gain, what leaves the fuller bin, what leaves the emptier one), with the greatest gain that fits."""
    room = capacity - _fill(full)
    out, into = _options(full), _options(low)
    best = None
    sums = sorted(into)
    for gone, a in out.items():
        at = bisect_left(sums, gone + room + 1) - 1
        while at >= 0 and sums[at] > gone:
            b = into[sums[at]]
            if b and len(a) + len(b) <= 3:
                gain = sums[at] - gone
                if best is None or gain > best[0]:
                    best = (gain, a, b)
                break
            at -= 1
    return best


class _Options:
    """What may leave a bin of some content, as bit sets of sums, so that a pair of bins is tested by a few shifts."""

    def __init__(self, content: tuple[tuple[int, int], ...]):
        found = _options(content)
        self.sums = [(s, len(pieces)) for s, pieces in found.items()]
        self.one = sum(1 << s for s, pieces in found.items() if len(pieces) == 1)
        self.any = self.one | sum(1 << s for s, pieces in found.items() if len(pieces) == 2)

    def gains(self, low: _Options, room: int) -> bool:
        """Whether the fuller bin, with this room, can be filled further from the emptier one."""
        mask = (1 << room) - 1
        return any((low.any if n < 2 else low.one) >> (s + 1) & mask for s, n in self.sums)


def local_search(bins: Bins, least: int) -> int:
    """Moves and exchanges between underfull bins until ``least`` bins are left or none helps; the number of steps.

    Every step grows the sum of squared fills, so the search ends by itself. A content is
    tested against all others when it is new, as the emptier bin and as the fuller one,
    and not again: the emptiest first.
    """
    total, steps, known = bins.total(), 0, {}
    queue = [(_fill(c), c) for c, _ in bins.groups() if _fill(c) < bins.capacity]
    heapq.heapify(queue)
    settled: set = set()

    def options(content: tuple[tuple[int, int], ...]) -> _Options:
        if content not in known:
            known[content] = _Options(content)
        return known[content]

    def partners(content: tuple[tuple[int, int], ...], n: int, room: int) -> tuple | None:
        own = options(content)
        for r in bins.rooms:
            if r > room:
                break
            if r:
                for full in bins.by_room[r]:
                    if (full != content or n > 1) and options(full).gains(own, r):
                        return full, content
        for r in reversed(bins.rooms):
            if r < room:
                break
            for low in bins.by_room[r]:
                if low in settled and low != content and own.gains(options(low), room):
                    return content, low
        return None

    while queue and total > least:
        fill, content = heapq.heappop(queue)
        room = bins.capacity - fill
        n = bins.by_room.get(room, {}).get(content, 0)
        if not n or content in settled:
            continue
        if (pair := partners(content, n, room)) is None:
            settled.add(content)
            continue
        full, low = pair
        times = n // 2 if full == low else min(bins.by_room[bins.capacity - _fill(x)][x] for x in pair)
        _, a, b = best_step(full, low, bins.capacity)
        bins.take(full, times)
        bins.take(low, times)
        made = _with(full, [*((k, -1) for k in a), *((k, 1) for k in b)]), _with(low, [*((k, -1) for k in b), *((k, 1) for k in a)])
        for x in made:
            bins.add(x, times)
        steps += 1
        total -= times * (not made[1])
        settled.difference_update(made)
        for x in {*made, full, low}:
            if x and x not in settled and bins.by_room.get(bins.capacity - _fill(x), {}).get(x) and _fill(x) < bins.capacity:
                heapq.heappush(queue, (_fill(x), x))
    return steps


def levels(groups: list[Group], base: int = BASE) -> list[tuple[int, list[Group]]]:
    """(scale, groups): together, with each bin taken ``scale`` times, they are the bins of ``groups``."""
    found, scale = [], 1
    while groups:
        if here := [(c, n % base) for c, n in groups if n % base]:
            found.append((scale, here))
        groups = [(c, n // base) for c, n in groups if n >= base]
        scale *= base
    return found


def searched(groups: list[Group], capacity: int) -> list[Group]:
    """The groups after a local search among them."""
    bins = Bins(capacity)
    for c, n in groups:
        bins.add(c, n)
    local_search(bins, -(-sum(_fill(c) * n for c, n in groups) // capacity))
    return bins.groups()


def searched_here(parts: list[tuple[int, list[Group]]], capacity: int) -> list[tuple[int, list[Group]]]:
    """All levels one after the other, in this process."""
    return [(scale, searched(groups, capacity)) for scale, groups in parts]


def plan(counts: dict[int, int], capacity: int = CAPACITY, search: Callable = searched_here) -> list[Group]:
    """Groups of bins that hold every piece of every length once; ``search`` works on levels."""
    bins = best_fit(counts, capacity)
    groups = bins.groups()
    if bins.total() <= -(-sum(k * n for k, n in counts.items()) // capacity):
        return groups
    made: Counter = Counter({c: n for c, n in groups if _fill(c) == capacity})
    for scale, level in search(levels([(c, n) for c, n in groups if _fill(c) < capacity]), capacity):
        for c, n in level:
            made[c] += n * scale
    return sorted(made.items())


class Places:
    """For each length: from which number on a group of bins holds its pieces, how many a bin, and where."""

    def __init__(self, groups: list[Group]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        given: Counter = Counter()
        sequence = 0
        for content, n in groups:
            offset = 0
            for length, each in content:
                rows.setdefault(length, []).append((given[length], each, sequence, offset))
                given[length] += n * each
                offset += length * each
            sequence += n
        self.sequences = sequence
        self.rows = {k: np.array(v, dtype=np.int64).T for k, v in rows.items()}

    def of(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the pieces with these numbers among those of the length."""
        first, each, sequence, offset = self.rows[length]
        at = np.searchsorted(first, number, "right") - 1
        inside = number - first[at]
        return sequence[at] + inside // each[at], offset[at] + inside % each[at] * length


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = vocabulary(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            columns: list[list[int]] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.encode(text.as_py() or "") + END
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n % capacity or capacity) if piece == 0 else capacity
                    for to, x in zip(columns, (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]), strict=True):
                        to.append(x)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            doc, piece, start, length, crc, number = columns
            long = pa.int64()
            yield pa.record_batch([pa.array(doc, long), pa.array(piece, pa.int32()), pa.array(start, long), pa.array(length, long), pa.array(crc, long), pa.array([part] * len(doc), pa.int32()), pa.array(number, long)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return cut


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = shared.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    sequence[at], offset[at] = places.of(int(length[at[0]]), number[at])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def _searched_in_tasks(spark: SparkSession) -> Callable:
    """Searches the levels in a task each; a level is a few groups for each length, in and out."""

    def search(parts: list[tuple[int, list[Group]]], capacity: int) -> list[tuple[int, list[Group]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [pickle.dumps(searched(pickle.loads(x), capacity)) for x in batch.column("level").to_pylist()]
                yield pa.record_batch([batch.column("scale"), pa.array(done, pa.binary())], names=["scale", "level"])

        schema = "scale bigint, level binary"
        rows = [(scale, pickle.dumps(groups)) for scale, groups in parts]
        dealt = spark.createDataFrame(rows, schema).repartitionByRange(len(rows), "scale")
        return [(r["scale"], pickle.loads(r["level"])) for r in dealt.mapInArrow(run, schema).collect()]

    return search


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    pieces = materialise(docs_view(docs).mapInArrow(_cutter(tokenizer or public_path(), capacity), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(Places(plan(counts, capacity, _searched_in_tasks(spark))))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Counted again rather than written: a table of a few numbers would be a file for each shuffle partition.
    found = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = found.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # As many rows as lengths and partitions: not to be sent to all.
    numbered = pieces.join(first.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("first")).alias("number"))
    return numbered.mapInArrow(_placer(shared), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
