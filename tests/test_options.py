"""Options of counting, scoring, pruning and reading that small hand-made tables settle."""

import math
from collections import Counter, defaultdict
from itertools import product

import pytest
from lexspark.operators import counting, merging, scoring, shrinking, smoothing, stochastic
from lexspark.sources import text as files
from pyspark.sql import functions as F

TEXTS = ["a b a c", "a b", "a b c b", "b c", "c a b a", "d a", ""]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return smoothing.witten_bell(counting.count(corpus, 3).persist(), 3)


def as_dicts(model):
    grams = {(tuple(filter(None, r["hist"].split(" "))), r["word"]): r["p"] for r in model.grams.collect()}
    return grams, {tuple(r["hist"].split(" ")): r["alpha"] for r in model.backoffs.collect()}


def chance(grams, alphas, hist, word):
    if (hist, word) in grams:
        return grams[hist, word]
    return alphas.get(hist, 1.0) * chance(grams, alphas, hist[1:], word) if hist else None


def test_column_file(spark, tmp_path):
    (tmp_path / "good").write_text("a\tb\t-0.5\nc\td\t1e-3\ne\tf\t0.12345678\ng\nh\ti\nj\tk\t+2.\nl\tm\tInfinity\n")
    got = {r["istring"]: (r["ostring"], r["weight"]) for r in files.column_file(spark, str(tmp_path / "good")).collect()}
    assert got == {"a": ("b", -0.5), "c": ("d", 1e-3), "e": ("f", 0.12345678), "g": ("g", 0.0), "h": ("i", 0.0), "j": ("k", 2.0), "l": ("m", math.inf)}
    for line in ("a\tb\tjunk", "a\tb\t1\t2", "a\tb\t1d"):
        (tmp_path / "bad").write_text(line + "\n")
        with pytest.raises(Exception, match="not a weight|more than three"):
            files.column_file(spark, str(tmp_path / "bad")).collect()


def test_unknown_words_leave_the_model_normalised(spark, model):
    scaled = scoring.with_unknown(model, 0.1)
    grams, alphas = as_dicts(scaled)
    words = {w for h, w in grams if not h}
    for hist in [(), *alphas]:
        assert math.isclose(sum(chance(grams, alphas, hist, w) for w in words) + 0.1 * math.prod(alphas.get(hist[k:], 1.0) for k in range(len(hist))), 1, rel_tol=1e-9)
    events = spark.createDataFrame([("a b", "zz"), ("", "zz"), ("a", "b"), ("q", "a")], "hist string, word string")
    for r in scoring.score(events, model, 0.1, 1000).collect():
        hist = tuple(filter(None, r["hist"].split(" ")))
        want = 0.1 / 1000 * math.prod(alphas.get(hist[k:], 1.0) for k in range(len(hist))) if r["word"] == "zz" else chance(grams, alphas, hist, r["word"])
        assert math.isclose(r["p"], want, rel_tol=1e-9) and r["oov"] == (r["word"] == "zz")


def test_a_named_symbol_stands_for_unknown_words(spark, model):
    grams, alphas = as_dicts(model)
    events = spark.createDataFrame([("a", "zz"), ("a", "d"), ("d", "a")], "hist string, word string")
    got = {r["word"]: (r["p"], r["oov"]) for r in scoring.score(events, model, oov_size=50, oov_symbol="d").collect()}
    assert math.isclose(got["zz"][0], alphas[("a",)] * grams[(), "d"] / 50) and got["zz"][1]
    assert math.isclose(got["d"][0], chance(grams, alphas, ("a",), "d") / 50) and got["d"][1]
    assert math.isclose(got["a"][0], chance(grams, alphas, ("d",), "a")) and not got["a"][1]
    with pytest.raises(ValueError):
        scoring.score(events, model, oov=0.1, oov_symbol="d")


def test_perplexity_in_a_context(spark, model):
    grams, alphas = as_dicts(model)
    test = spark.createDataFrame([(0, "a b c zz a")], "doc_id bigint, text string")
    r = scoring.perplexity(test, model, inside=merging.in_context(F.col("hist"), ["b"], ["c"])).collect()[0]
    assert math.isclose(r["logprob10"], math.log10(chance(grams, alphas, ("a", "b"), "c")), rel_tol=1e-9) and r["words"] == 5 and r["skipped"] == 1
    whole = scoring.perplexity(test, model).collect()[0]
    steps = [(("<s>",), "a"), (("<s>", "a"), "b"), (("a", "b"), "c"), ((), "a"), (("a",), "</s>")]
    assert math.isclose(whole["logprob10"], sum(math.log10(chance(grams, alphas, h, w)) for h, w in steps), rel_tol=1e-9)


def test_histograms_against_all_outcomes(spark):
    rows = [("a a b", 0.5), ("a b b b", 0.25), ("a", 0.5), ("b", 1.0)]
    table = spark.createDataFrame(rows, "text string, w double")
    got = {r["word"]: (r["expected"], r["p"]) for r in counting.histogram(table, 1, most=3, weight=F.col("w")).where("hist = ''").collect()}
    want = defaultdict(lambda: [0.0] * 9)
    for there in product((0, 1), repeat=len(rows)):
        p = math.prod(w if t else 1 - w for t, (_, w) in zip(there, rows, strict=True))
        held = Counter(x for t, (text, _) in zip(there, rows, strict=True) if t for x in text.split())
        for x in "ab":
            want[x][held[x]] += p
    for x in "ab":
        assert math.isclose(got[x][0], sum(k * p for k, p in enumerate(want[x])))
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[x][1], want[x][:4], strict=True))
    often = counting.count_of_histograms(counting.histogram(table, 1, most=3, weight=F.col("w")))
    assert math.isclose({(r["ord"], r["r"]): r["n"] for r in often.collect()}[1, 2], sum(want[x][2] for x in "ab") + counting.histogram(table, 1, most=3, weight=F.col("w")).where("word = '</s>'").first()["p"][2])


def test_certain_rows_have_certain_histograms(corpus):
    total = Counter(w for t in TEXTS for w in t.split())
    for r in counting.histogram(corpus, 1, most=4).where("word != '</s>'").collect():
        assert r["expected"] == total[r["word"]] and r["p"] == [float(k == total[r["word"]]) for k in range(5)]


def test_marginals_are_kept(spark):
    """By adding up every path: a state's own words, and what backs off to shorter states."""
    rows = spark.createDataFrame([(t,) for t in TEXTS * 2 + ["a c a", "b a b", "c c"]], "text string")
    for order in (2, 3):
        base = smoothing.absolute(counting.count(rows, order).persist(), order)
        made = stochastic.marginalised(base)
        old, old_alphas = as_dicts(base)
        new, alphas = as_dicts(made)
        assert all(math.isclose(sum(p for (h, _), p in new.items() if h == hist), sum(p for (h, _), p in old.items() if h == hist), rel_tol=1e-6) for hist in {h for h, _ in old})
        ph = {(): 1.0}
        for n in range(1, order):
            for (h, w), p in old.items():
                if len(h) == n - 1:
                    key = (*h, "<s>") if w == "</s>" and not h else (*h, w)
                    if not (h and w == "</s>"):
                        ph[key] = ph[h] * p if h else p
        states = {h for h, _ in old if h} | {()}
        d = {h: max(ph[h] - sum(ph[x] for x in states if x and x[1:] == h and len(x) == len(h) + 1), 1e-20) for h in states}
        norm = sum(d.values())
        for w in {w for h, w in old if not h}:
            got = sum(d[h] / norm * chance(new, alphas, h, w) for h in states)
            assert math.isclose(got, old[(), w], rel_tol=0.05), (order, w, got, old[(), w])


def test_sizes_of_shrunk_models(model):
    scores = shrinking.relative_entropy_scores(model)
    grams, one = model.grams.count(), model.grams.where("ord = 1").count()
    for target in (one, one + 3, one + 7, grams):
        theta = shrinking.theta_for_size(model, scores, target)
        assert shrinking.shrink(model, scores, theta).grams.count() <= target
    effective = sorted((r["score"] for r in shrinking.propagated(scores, 3).collect()), reverse=True)
    assert math.isclose(shrinking.theta_for_size(model, scores, one + 1), (effective[0] + max(x for x in effective if x < effective[0])) / 2) or effective.count(effective[0]) > 1


def test_dispatch(spark, model):
    with pytest.raises(ValueError):
        shrinking.shrunk(model, "other")
    with pytest.raises(ValueError):
        shrinking.shrunk(model, "seymore", least_order=1)
    assert {r["ord"] for r in model.grams.join(shrinking.shrunk(model, "seymore", 1e9, total=100.0, least_order=3).grams, ["ord", "hist", "word"], "left_anti").collect()} == {3}
    inside = merging.in_context(F.col("hist"), ["b"], ["c"])
    joint = shrinking.shrunk(model, "relative_entropy", 0.0, inside=inside).grams
    assert joint.where("ord = 3").count() == model.grams.where("ord = 3").where(inside).join(shrinking.shrunk(model, "relative_entropy", 0.0).grams, ["ord", "hist", "word"], "left_semi").count()
    listed = spark.createDataFrame([("A b",)], "ngram string")
    assert shrinking.shrunk(model, "list_prune", listed=listed).grams.count() == model.grams.count()
    fewer = shrinking.shrunk(model, "list_prune", listed=listed, retry_lower=True).grams
    assert fewer.where("hist = 'a' and word = 'b' or hist = 'a b' or (hist like '% a' and word = 'b')").count() == 0
    one = shrinking.shrunk(model, "relative_entropy", 0.0, one_by_one=True)
    assert smoothing.topology_faults(one.grams).count() == 0


def test_estimated_total(spark):
    rows = spark.createDataFrame([("a a a b b c d d d d",)], "text string")
    counts = counting.count(rows, 1)
    assert math.isclose(shrinking.estimated_total(smoothing.unsmoothed(counts, 1)), 11, rel_tol=1e-9)


def test_contexts_by_mass(spark):
    rows = spark.createDataFrame([(2, w, "x", c) for w, c in [("a", 90), ("b", 1), ("c", 1), ("d", 1), ("e", 80), ("f", 1)]], "ord int, hist string, word string, c bigint")
    assert merging.choose_contexts(rows, 2) == [["b"]]
    got = {r["h"] for r in spark.createDataFrame([("",), ("b",), ("a b",), ("c b",), ("c",)], "h string").where(merging.in_extended(F.col("h"), ["b", "c"], ["c"])).collect()}
    assert got == {"", "b", "c b"}


def test_stationary_shares(spark):
    """A chain of two states that takes turns, and one with given odds."""
    edges = spark.createDataFrame([("s", "a", 2.0), ("a", "s", 7.0)], "src string, dst string, weight double")
    assert {r["state"]: round(r["share"], 9) for r in stochastic.stationary_shares(edges, "s").collect()} == {"s": 0.5, "a": 0.5}
    edges = spark.createDataFrame([("s", "a", 1.0), ("a", "a", 3.0), ("a", "s", 1.0)], "src string, dst string, weight double")
    assert {r["state"]: round(r["share"], 9) for r in stochastic.stationary_shares(edges, "s").collect()} == {"s": 0.2, "a": 0.8}
