"""Hand-made corpora for counting, smoothing, scoring, pruning and merging."""

import math
from collections import Counter

import pytest
from lexspark.operators import counting, merging, scoring, shrinking, smoothing
from lexspark.sources import arpa
from pyspark.sql import functions as F

TOY = ["a b a", "a b", "a b", "b", "", None]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TOY)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def counts(corpus):
    return counting.count(corpus, 2).persist()


def by_gram(df, value):
    return {(r["hist"], r["word"]): r[value] for r in df.collect()}


def test_counts_by_hand(counts):
    want = Counter()
    for t in TOY:
        s = ["<s>", *(t or "").split(), "</s>"]
        want.update(("", w) for w in s[1:])
        want.update(zip(s, s[1:], strict=False))
    assert by_gram(counts, "c") == dict(want)
    assert by_gram(counting.history_totals(counts).select("hist", F.lit("").alias("word"), "total"), "total")["", ""] == sum(n for (h, _), n in want.items() if h == "")


def test_suffix_of_long_histories(spark):
    rows = spark.createDataFrame([("a b c",), ("a",), ("",)], "hist string")
    assert [r[0] for r in rows.select(counting.suffix("hist")).collect()] == ["b c", "", ""]


@pytest.mark.parametrize("method", ["witten_bell", "absolute", "katz", "kneser_ney", "modified_kneser_ney", "unsmoothed", "presmoothed"])
def test_models_are_normalised(corpus, method):
    model = smoothing.make(counting.count(corpus, 3).persist(), method, 3)
    full = smoothing.normalisation(model)
    if method in ("unsmoothed", "presmoothed"):
        assert full.where("total > 1.000001").count() == 0
    else:
        assert full.where("abs(total - 1) > 0.001").where("hist != ''").join(model.backoffs.where("alpha > 1e-30"), "hist", "left_semi").count() == 0
    assert smoothing.topology_faults(model.grams).count() == 0


def test_witten_bell_by_hand(counts):
    p = by_gram(smoothing.witten_bell(counts, 2).grams, "p")
    one = {w: p["", w] for w in ("a", "b", "</s>")}
    assert math.isclose(one["a"], 4 / 14) and math.isclose(one["</s>"], 6 / 14)
    assert math.isclose(p["a", "b"], 3 / (4 + 2) + 2 / 6 * one["b"])


def test_history_with_every_word(spark):
    rows = spark.createDataFrame([("a a b",), ("a",)], "text string")
    model = smoothing.witten_bell(counting.count(rows, 2).persist(), 2)
    assert by_gram(model.backoffs.select("hist", F.lit("").alias("word"), "alpha"), "alpha")["a", ""] == pytest.approx(math.exp(-99))


def test_backoff_and_interpolate_exclude_each_other(counts):
    with pytest.raises(ValueError):
        smoothing.make(counts, "katz", 2, backoff=True, interpolate=True)


def test_scores_and_unknown_words(spark, corpus):
    model = smoothing.witten_bell(counting.count(corpus, 2).persist(), 2)
    test = spark.createDataFrame([(1, "x a b"), (2, "a x"), (3, "a b x b")], "doc_id bigint, text string")
    r = scoring.perplexity(test, model).collect()[0]
    assert (r["sentences"], r["words"], r["oovs"], r["skipped"]) == (3, 9, 3, 3)
    p, a = by_gram(model.grams, "p"), by_gram(model.backoffs.select("hist", F.lit("").alias("word"), "alpha"), "alpha")
    way = lambda h, w: p.get((h, w), a.get((h, ""), 1) * p["", w])
    want = sum(map(math.log10, [p["", "a"], way("a", "b"), way("b", "</s>"), way("<s>", "a"), p["", "</s>"], way("<s>", "a"), way("a", "b"), p["", "b"], way("b", "</s>")]))
    assert math.isclose(r["logprob10"], want, rel_tol=1e-9)
    assert math.isclose(r["perplexity"], 10 ** (-want / (9 - 3 + 3)), rel_tol=1e-9)
    mass = scoring.perplexity(test, model, oov=0.01).collect()[0]
    assert mass["skipped"] == 0 and mass["oovs"] == 3


def test_arpa_round_trip(tmp_path, spark, counts):
    model = smoothing.witten_bell(counts, 2)
    arpa.write(model, str(tmp_path / "m"))
    again = arpa.read(spark, str(tmp_path / "m"))
    a, b = by_gram(model.grams, "p"), by_gram(again.grams, "p")
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-4) for k in a)


def test_shards_merge_to_the_whole(corpus, counts):
    parts = [counting.count(corpus.where(f"doc_id % 2 = {k}"), 2) for k in (0, 1)]
    assert by_gram(merging.merge_counts(*parts), "c") == by_gram(counts, "c")


def test_pruning(counts, corpus):
    three = counting.count(corpus, 3).persist()
    kept = by_gram(shrinking.count_prune(three, "2+:2", 3), "c")
    assert all(n >= 2 for (h, _), n in kept.items() if h) and ("", "a") in kept
    gone = by_gram(shrinking.list_prune(three, corpus.sparkSession.createDataFrame([("a",)], "ngram string"), 3), "c")
    assert all("a" not in f"{h} {w}".split() for h, w in gone if h) and ("", "a") in gone
    model = smoothing.witten_bell(counts, 2)
    sizes = [shrinking.seymore(model, t, 100.0).grams.count() for t in (-1e9, 0.5, 1e9)]
    assert sizes[0] == model.grams.count() and sizes[0] >= sizes[1] >= sizes[2] == 3
    with pytest.raises(ValueError):
        shrinking.count_prune(three, "x", 3)


def test_contexts():
    assert merging.check_contexts([(["b"], ["c"]), ([], ["b"])]) == [([], ["c"])]
    with pytest.raises(ValueError):
        merging.check_contexts([([], ["c"]), (["b"], [])])


def test_model_merge_of_equals(counts):
    model = smoothing.witten_bell(counts, 2)
    a, b = by_gram(model.grams, "p"), by_gram(merging.merge_models(model, model, 2.0, 5.0).grams, "p")
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
