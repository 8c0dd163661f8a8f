"""Pruning by lists and patterns, and what n-grams need, with few joins."""

import numpy as np
import pyarrow as pa
from lexspark.operators import counting, greedy, shrinking, smoothing
from pyspark.sql import functions as F

TEXTS = [("a b c a b the of a",), ("the a b x y",), ("b c a b c",)]


def test_short_and_long_lists_prune_alike(spark, monkeypatch):
    grams = counting.count(spark.createDataFrame(TEXTS, "text string"), 3)
    listed = spark.createDataFrame([("the",), ("of a",), ("b c",), (None,)], "ngram string")
    want = {tuple(r) for r in grams.collect() if r["ord"] == 1 or not any(f" {x} " in f" {r['hist']} {r['word']} " for x in ("the", "of a", "b c"))}
    short = shrinking.list_prune(grams, listed, 3)
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert set(map(tuple, short.collect())) == want
    monkeypatch.setattr(shrinking, "SHORT_LIST", 1)
    assert set(map(tuple, shrinking.list_prune(grams, listed, 3).collect())) == want


def test_completion_reads_its_input_once(spark):
    grams = counting.count(spark.createDataFrame(TEXTS, "text string"), 3, only=[3])
    found = shrinking.complete(grams, 3)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    seqs = [["<s>", *t.split(), "</s>"] for (t,) in TEXTS]
    want = {(n, " ".join(s[i - n + 1 : i]), s[i]) for s in seqs for n in (1, 2, 3) for i in range(2, len(s))}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_pruning_by_pattern_looks_up_what_it_removes(spark):
    counts = counting.count(spark.createDataFrame(TEXTS, "text string"), 3)
    found = shrinking.count_prune(counts, "2:3;3+:2", 3)
    rows = {(r["ord"], r["hist"], r["word"]): r["c"] for r in counts.collect()}
    three = {k for k, c in rows.items() if k[0] == 3 and c >= 2}
    need = {(h.split(" ")[-1], w) for _, h, w in three} | {tuple(h.split(" ")) for _, h, _ in three}
    two = {k for k, c in rows.items() if k[0] == 2 and (c >= 3 or k[1:] in need)}
    assert {tuple(r)[:3] for r in found.collect()} == three | two | {k for k in rows if k[0] == 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_models_keep_what_is_one_history_shorter(spark):
    counts = counting.count(spark.createDataFrame(TEXTS, "text string"), 3)
    for model in (smoothing.witten_bell(counts, 3), smoothing.absolute(counts, 3, bins=2), smoothing.kneser_ney(counts, 3)):
        assert "Join" not in model.pairs._jdf.queryExecution().optimizedPlan().toString()
        p = {(r["hist"], r["word"]): r["p"] for r in model.grams.collect()}
        pairs = model.pairs.collect()
        assert len(pairs) == sum(h != "" for h, _ in p)
        assert all(r["q"] == p[" ".join(r["hist"].split(" ")[1:]), r["word"]] and r["p"] == p[r["hist"], r["word"]] for r in pairs)
        want = {r["hist"]: r["alpha"] for r in smoothing.backoffs(model.grams, 3).collect()}
        assert all(abs(r["alpha"] - want[r["hist"]]) < 1e-9 for r in model.backoffs.collect())
        plain = smoothing.Model(model.grams, smoothing.backoffs(model.grams, 3), 3)
        one, two = ({(r["hist"], r["word"]): r["score"] for r in shrinking.relative_entropy_scores(m).collect()} for m in (model, plain))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_faults_are_looked_for_one_kind_at_a_time(spark):
    grams = spark.createDataFrame([(1, "", "a"), (1, "", "b"), (2, "a", "b"), (2, "c", "b"), (2, "a", "c"), (2, "<s>", "a"), (3, "b a", "b"), (3, "<s> a", "a")], "ord int, hist string, word string")
    found = smoothing.topology_faults(grams)
    assert sorted(map(tuple, found.collect())) == sorted([(2, "a", "c", "suffix"), (2, "c", "b", "history"), (3, "b a", "b", "history"), (3, "<s> a", "a", "suffix")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_few_classes_need_no_queue(monkeypatch):
    rng = np.random.default_rng(5)

    def no_queue(*_):
        raise AssertionError("a queue for a few classes")

    cases = []
    for m in (1, 1, 2, 3, 7, 12) * 30:
        p, q = rng.uniform(1e-3, 0.5 / m, m).round(4), rng.uniform(1e-3, 0.5 / m, m).round(4)
        n, ph = rng.integers(1, 3, m), float(rng.choice([0.0, 1e-3, 0.5]))
        cases.append((p, q, n, max(0.0, 1 - float(p @ n)), 1 - float(q @ n), ph))
    monkeypatch.setattr(greedy, "FEW", 0)
    want = [greedy.removals(p, q, n, a, b, 1e-3 / ph if ph else float("inf")) for p, q, n, a, b, ph in cases]
    monkeypatch.setattr(greedy, "FEW", 12)
    monkeypatch.setattr(greedy, "_Queue", no_queue)
    found = [greedy.removals(p, q, n, a, b, 1e-3 / ph if ph else float("inf")) for p, q, n, a, b, ph in cases]
    assert all((x == y).all() for x, y in zip(want, found, strict=True)) and any(x.any() for x in want)
    rows = [(f"h{i:03}", x, y, int(z), a, b, ph) for i, (p, q, n, a, b, ph) in enumerate(cases) for x, y, z in zip(p.tolist(), q.tolist(), n.tolist(), strict=True)]
    batch = pa.Table.from_pylist([dict(zip(("hist", "p", "q", "n", "num", "den", "ph"), r, strict=True)) for r in rows]).combine_chunks().to_batches()[0]
    gone = [k for b in greedy.by_history(1e-3)(iter([batch])) for k in b.column("k").to_pylist()]
    assert gone == [int(k) for x in want for k in x if k]


def test_histograms_are_written_out(spark):
    rows = spark.createDataFrame([("a a b", 0.25), ("a", 0.5), ("a", 0.5), ("b b b b b b b a", 0.75)], "text string, w double")
    found = counting.histogram(rows, 1, weight=F.col("w"))
    have = {r["word"]: r for r in found.collect()}
    for word, given in {"a": [(2, 0.25), (1, 0.5), (1, 0.5), (1, 0.75)], "b": [(1, 0.25), (7, 0.75)]}.items():
        want = [1.0] + [0.0] * 40
        for c, w in given:
            want = [want[k] * (1 - w) + (want[k - c] * w if k >= c else 0.0) for k in range(len(want))]
        assert all(abs(x - y) < 1e-12 for x, y in zip(have[word]["p"], want, strict=False)) and len(have[word]["p"]) == 6
    assert "transform(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
