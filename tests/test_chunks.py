"""Counts of n-grams within chunks, and what models keep from their making."""

import random
import re
from collections import Counter

import pyarrow as pa
from lexspark.operators import chunks, counting

rng = random.Random(1)
TEXTS = [None, "", " ", "a", "<s> a </s>", "é ü\tx\n\ny  ", "\x0b a\xa0b", *(" ".join(rng.choice(["a", "b", "<s>", "</s>", "longword", "é"]) + rng.choice(["", "\t", "\n ", "\r", "\f"]) for _ in range(rng.randrange(30))) for _ in range(100))]


def brute(orders):
    found = Counter()
    for text in TEXTS:
        seq = ["<s>", *filter(None, re.split("[ \t\n\r\f]+", text or "")), "</s>"]
        for n in orders:
            for i in range(max(n - 1, 1), len(seq)):
                found[n, " ".join(seq[i - n + 1 : i]), seq[i]] += 1
    return found


def test_chunks_of_any_size_count_alike():
    for orders in ([1], [3], [1, 2, 3], [2, 5], [30]):
        for most in (10, 1000, chunks.CHUNK):
            batches = [pa.record_batch([pa.array(TEXTS[i : i + 40], pa.string())], names=["text"]) for i in range(0, len(TEXTS), 40)]
            found = Counter()
            for batch in chunks.counter(orders, most)(iter(batches)):
                for r in batch.to_pylist():
                    found[r["ord"], r["hist"], r["word"]] += r["c"]
            assert found == brute(orders)
    assert not list(chunks.counter([1, 2])(iter([pa.record_batch([pa.array([], pa.string())], names=["text"])])))


def test_counts_come_summed_to_the_shuffle(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    found = counting.count(rows, 3)
    assert {(r["ord"], r["hist"], r["word"]): r["c"] for r in found.collect()} == brute([1, 2, 3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    by = counting.count(rows.selectExpr("text", "length(text) % 2 as k"), 3, by=["k"]).groupBy("ord", "hist", "word").sum("c")
    assert {(r["ord"], r["hist"], r["word"]): r["sum(c)"] for r in by.collect()} == brute([1, 2, 3])
