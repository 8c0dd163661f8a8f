import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.llm import token_files
from lexspark.llm.perfect_hash import PerfectHash, fingerprints
from lexspark.llm.pretokens import public_path, vocabulary
from lexspark.llm.queries import op13_token_files
from lexspark.llm.runs import Runs, numbered
from lexspark.llm.token_files import _open, checksums, lookup, places, shards, write


@pytest.fixture
def spread(spark):
    """Small partitions stay as they are, as on a cluster with much more data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def ids_of(text):
    return np.array([*vocabulary(public_path()).whole(text or ""), 0], dtype="<u4")


def test_round_trip(documents, spark, spread):
    texts = {i: f"text {i} of some words " * (i % 7) for i in range(500)} | {3: None, 4: "", 5: "!" * 50}
    docs = documents(*texts.items()).repartition(6)
    folder = write(docs, bucket=60)
    rows = sorted(token_files.documents(docs.selectExpr("doc_id as key"), folder).collect(), key=lambda r: r["key"])
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        want = ids_of(texts[i])
        assert (r["key"], r["start"], r["n"]) == (i, at, len(want)) and np.frombuffer(r["ids"], "<u4").tolist() == want.tolist()
        at += len(want)
    # The payload is the ids of all documents in ascending order, and nothing else.
    store, root = _open(folder)
    raw = b""
    for s in sorted(shards(spark, folder).collect(), key=lambda s: s["start"]):
        assert s["start"] * s["width"] == len(raw)
        with store.open_input_file(f"{root}/{s['file']}") as f:
            raw += f.read()
    assert raw == b"".join(ids_of(texts[i]).astype("<u2").tobytes() for i in sorted(texts))
    assert len(spark.read.parquet(f"{folder}/buckets").collect()) == 9


def test_keyed_access(documents, spark):
    docs = documents((10, "ten"), (20, "twenty"), (30, None))
    folder = write(docs)
    asked = spark.createDataFrame([(20, 1), (10, 1), (20, 2), (40, 1), (None, 1)], "key bigint, occurrence bigint")
    found = {(r["key"], r["occurrence"]): r for r in lookup(asked, folder).collect()}
    assert set(found) == {(20, 1), (10, 1)}  # others aren't there: their fingerprints differ
    assert np.frombuffer(found[20, 1]["ids"], "<u4").tolist() == ids_of("twenty").tolist() and found[20, 1]["start"] == len(ids_of("ten"))
    assert {(r["key"], r["copies"]) for r in places(asked, folder).collect()} == {(20, 1), (10, 1)}


def test_a_frequent_key_covers_several_tasks(documents, spark, spread):
    docs = documents(*((7 if i % 3 == 0 else i, f"text {i % 50}") for i in range(900))).repartition(8)
    folder = write(docs, bucket=100)
    rows = checksums(docs.selectExpr("doc_id as key"), folder).collect()
    assert sum(r["key"] == 7 for r in rows) == 301 and len(rows) == 900
    want = sorted((7 if i % 3 == 0 else i, zlib.crc32(ids_of(f"text {i % 50}").tobytes())) for i in range(900))
    assert sorted((r["key"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    held = [s["docs"] for s in shards(spark, folder).collect()]
    assert max(held) < 400  # of 301 copies, no task has all and its share of the rest besides


def test_odd_rows(odd, empty, spark, spread):
    folder = write(odd)
    rows = checksums(odd.selectExpr("doc_id as key"), folder).collect()
    source = odd.select("doc_id", "text").collect()
    assert sorted(((r["key"] is None, r["key"] or 0, r["ids_crc32"]) for r in rows)) == sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32(ids_of(r["text"]).tobytes())) for r in source)
    last = max(rows, key=lambda r: r["start"])
    assert last["key"] is None  # null keys come last
    folder = write(empty)
    assert checksums(empty.selectExpr("doc_id as key"), folder).count() == 0
    assert checksums(odd.selectExpr("doc_id as key"), folder).count() == 0


def test_query(spark, small):
    rows = {r["doc_id"]: r for r in op13_token_files(spark, small).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        want = ids_of(r["text"])
        got = rows.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert not rows


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 5)), max_size=300), st.integers(0, 24))
def test_perfect_hash(keys, levels):
    high = np.array([a for a, _ in keys], dtype=np.uint64)
    low = np.array([b for _, b in keys], dtype=np.uint64)
    made, n = PerfectHash.load((raw := PerfectHash.build(high, low, levels).dump()) + b"more")
    assert n == len(raw) and len(made) == len(keys)
    assert sorted(made.slots(high, low).tolist()) == list(range(len(keys)))


def test_perfect_hash_of_many_keys():
    high = np.arange(200_000, dtype=np.uint64)
    low = np.ones(len(high), dtype=np.uint64)
    made = PerfectHash.build(high, low)
    slots = made.slots(high, low)
    assert np.array_equal(np.sort(slots), np.arange(len(high)))
    assert 8 * len(made.dump()) / len(high) < 4.2  # bits a key
    prints = np.zeros(len(high), dtype="<u4")
    prints[slots] = fingerprints(high, low)
    other = high + np.uint64(10**9)
    got = made.slots(other, low)
    assert (prints[got[got >= 0]] == fingerprints(other, low)[got >= 0]).sum() == 0


def test_a_damaged_index_is_refused():
    raw = bytearray(PerfectHash.build(np.arange(50, dtype=np.uint64), np.ones(50, dtype=np.uint64)).dump())
    raw[40] ^= 1
    with pytest.raises(ValueError):
        PerfectHash.load(bytes(raw))


def test_numbers_within_keys(spark):
    """Keys that cover parts of partitions, whole ones and several."""
    keys, rows = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 4, None, None, None], []
    for part, (a, b) in enumerate([(0, 3), (3, 5), (5, 6), (6, 9), (9, 13), (13, 15)]):
        runs = Runs()
        rows += [(k, 2 * part, *runs.next(k)) for k in keys[a:b]]
    found = numbered(spark.createDataFrame(rows, "key bigint, part int, row bigint, run bigint"), "key", "number").orderBy("part", "row").collect()
    assert [r["number"] for r in found] == [1, 2, 1, 2, 3, 4, 5, 6, 1, 1, 2, 3, 1, 2, 3]

