"""Training, stochastic automata, lattices, sampling, sources, streaming and the registry."""

import math

import pytest
from lexspark.functions import semiring, tokens
from lexspark.operators import counting, distance, em, lattices, sampling, smoothing, stochastic
from lexspark.operators.fst import Fst, accep, union
from lexspark.sources import text as files
from pyspark.sql import functions as F


def test_long_pairs_keep_their_likelihood(spark):
    letters = [chr(97 + i) for i in range(26)]
    p = {(a, b): 1 / 700 for a in [*letters, ""] for b in [*letters, ""] if a or b}
    x = [letters[i * 7 % 26] for i in range(200)]
    counts, like = em.expectations(x, x[::-1], p)
    assert -2_000 < like < -500 and math.isclose(sum(n for (a, _), n in counts.items() if a), 200, rel_tol=1e-9)
    found = {(r["ilabel"], r["olabel"]): r["n"] for r in em.e_step(spark.createDataFrame([(["a"], ["a"]), (["a"], ["z"])], "x array<string>, y array<string>"), {("a", "a"): 1.0}).collect()}
    assert found[None, "lost"] == 1 and found["a", "a"] == 1 and found[None, None] == 0


def test_expectations_by_hand():
    p = {("a", "x"): 0.5, ("a", ""): 0.25, ("", "x"): 0.25}
    counts, like = em.expectations(["a"], ["x"], p)
    total = 0.5 + 2 * 0.25 * 0.25
    assert math.isclose(like, math.log(total)) and math.isclose(counts["a", "x"], 0.5 / total) and math.isclose(counts["a", ""], 0.125 / total)
    assert em.align(["a"], ["x"], p)[0] == [("a", "x")]
    assert em.expectations(["b"], ["x"], p)[1] == -math.inf


def test_training_recovers_a_substitution(spark):
    key = {"a": "x", "b": "y", "c": "z"}
    words = ["abc", "aab", "cba", "bca", "ccab", "ba"]
    pairs = spark.createDataFrame([(list(w), [key[c] for c in w]) for w in words], "x array<string>, y array<string>")
    model, history = em.train(pairs, em.initial(spark, list("abc"), list("xyz"), 3, insertions=False, deletions=False), 12)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    best = {}
    for r in model.collect():
        if r["ilabel"] and r["p"] > best.get(r["ilabel"], ("", 0))[1]:
            best[r["ilabel"]] = (r["olabel"], r["p"])
    assert {k: v[0] for k, v in best.items()} == key
    prior = {(a, b): 1 / 3 for a in ["", *"abc"] for b in ["", *"abc"]}
    errors = em.decode(pairs, model, prior, list("abc")).select(em.hamming().alias("e")).agg(F.sum("e")).first()[0]
    assert errors == 0


@pytest.fixture
def loop():
    """a with 0.5 to 1, b with 0.3 by failure through 1; ends."""
    return stochastic.FailureAutomaton(0, [{"a": (0.5, 1)}, {"a": (0.2, 1), "b": (0.3, 0)}], [0.0, 0.5], [(0.625, 1), None])


def test_stochastic_automata(loop):
    assert stochastic.phi_order(loop) == [1, 0] and stochastic.is_normalized(loop) and stochastic.is_canonical(loop)
    plain = stochastic.without_phi(loop)
    assert stochastic.is_normalized(plain) and plain.phi == [None, None]
    assert all(abs(x - 1) < 1e-6 for x in stochastic.shortest_distance(loop))
    assert stochastic.equal(stochastic.phi_normalized(loop), loop, ignore_phi=False)
    assert math.isclose(sum(stochastic.stationary(loop)), 1)
    assert math.isclose(stochastic.perplexity(loop, plain), stochastic.perplexity(loop, loop), rel_tol=1e-9)
    once = stochastic.trimmed(loop)
    assert stochastic.equal(stochastic.trimmed(once), once) and stochastic.isomorphic(once, loop)
    both = stochastic.intersected(loop, plain)
    assert len(both.arcs) == 2
    assert len(stochastic.random_strings(loop, 5, 1)) == 5
    assert stochastic.info(loop)["states"] == 2
    with pytest.raises(ValueError):
        stochastic.phi_order(stochastic.FailureAutomaton(0, [{}], [1.0], [(1.0, 0)]))


def test_approximation_of_itself(loop):
    plain = stochastic.without_phi(loop)
    again = stochastic.approximated(loop, plain)
    for a, b in zip(stochastic.state_sums(again), stochastic.state_sums(plain), strict=True):
        assert math.isclose(a, b, rel_tol=1e-6)
    assert all(math.isclose(again.arcs[s][x][0], plain.arcs[s][x][0], rel_tol=1e-6) for s in range(2) for x in plain.arcs[s])
    t = stochastic.ngram_topology([["a", "b"], ["a"]], 2)
    assert stochastic.is_backoff_complete(t)


def test_lattice_counts_of_a_string():
    words = {97: "a", 98: "b"}
    assert lattices.expected_counts(accep("ab"), words, 2) == {("a",): 1, ("<s>", "a"): 1, ("b",): 1, ("a", "b"): 1, ("</s>",): 1, ("b", "</s>"): 1}
    two = union(accep("a", math.log(2)), accep("b", math.log(2)))
    counts = lattices.expected_counts(two, words, 1)
    assert math.isclose(counts["a",], 0.5) and math.isclose(counts["</s>",], 1.0)
    with pytest.raises(ValueError):
        lattices.expected_counts(Fst(0, (((97, 97, 0.0, 0),),), {0: 0.0}), words, 1)


def test_model_on_lattices_and_samples(spark):
    rows = spark.createDataFrame([("a b a b",), ("a b",), ("b",)], "text string")
    model = smoothing.witten_bell(counting.count(rows, 2).persist(), 2)
    scorer = lattices.Scorer.collect(model)
    exact = lattices.apply_model(accep("ab"), {97: "a", 98: "b"}, scorer)
    loose = lattices.apply_model(accep("ab"), {97: "a", 98: "b"}, scorer, "epsilon")
    from lexspark.operators.fst import best_paths

    a, b = (next(best_paths(f, 1))[2] for f in (exact, loose))
    p = {(r["hist"], r["word"]): r["p"] for r in model.grams.collect()}
    assert math.isclose(a, -sum(map(math.log, (p["<s>", "a"], p["a", "b"], p["b", "</s>"])))) and b <= a + 1e-9
    out = sampling.sentences(spark, model, 50, 3, 3)
    assert out.count() == 50 and sorted(out.collect()) == sorted(sampling.sentences(spark, model, 50, 3, 3).collect())
    assert {w for r in out.collect() for w in r["text"].split()} <= {"a", "b"}


def test_histograms_convolve(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.75, 0.0])], "a array<double>, b array<double>")
    assert df.select(counting.convolved(F.col("a"), F.col("b"), 3)).first()[0] == pytest.approx([0.125, 0.5, 0.375])


def test_semiring(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    r = df.select(semiring.neg_log_sum(F.col("a"), F.col("b")).alias("s"), semiring.neg_log_diff(F.col("a"), F.col("b")).alias("d"), semiring.unsigned(semiring.signed(F.col("a") - F.col("b"))).alias("u")).first()
    assert math.isclose(r["s"], -math.log(math.exp(-1) + math.exp(-2))) and math.isclose(r["d"], -math.log(math.exp(-1) - math.exp(-2))) and math.isclose(r["u"], -1)


def test_tokens(spark):
    df = spark.createDataFrame([(" a\t b\n",), (None,), ("é",)], "s string")
    assert [r[0] for r in df.select(tokens.tokens(F.col("s"))).collect()] == [["a", "b"], [], ["é"]]
    assert df.where("s = 'é'").select(tokens.bytes_of(F.col("s")), tokens.codepoints(F.col("s"))).first()[:] == ([195, 169], [233])


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\t2\nc # note\n\nd\\#e\n")
    rows = {r["istring"]: (r["ostring"], r["weight"]) for r in files.column_file(spark, str(tmp_path / "m.tsv")).collect()}
    assert rows == {"a": ("b", 2.0), "c ": ("c ", 0.0), "d#e": ("d#e", 0.0)}
    (tmp_path / "bad.tsv").write_text("a\tb\t2\tx\n")
    with pytest.raises(Exception, match="three columns"):
        files.column_file(spark, str(tmp_path / "bad.tsv")).collect()
    counts = counting.count(spark.createDataFrame([("a b",)], "text string"), 2)
    files.ngram_lines(counts).select("line").write.text(str(tmp_path / "n"))
    assert sorted(map(tuple, files.read_ngrams(spark, str(tmp_path / "n")).collect())) == sorted((r[0], r[1], r[2], float(r[3])) for r in counts.collect())
    files.write_archive(spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int"), str(tmp_path / "far"))
    assert files.find(spark, str(tmp_path / "far"), "l").first()["v"] == 2


def test_distances(spark):
    assert distance.distance("kitten", "sitting") == 3 and distance.distance("ab", "xy", bound=1) is None and distance.distance("a", "b", substitute=5) == 2
    q = spark.createDataFrame([("cot",), ("dag",), ("zzzzzz",)], "query string")
    e = spark.createDataFrame([("cat",), ("dog",), ("cut",)], "entry string")
    assert sorted(tuple(r) for r in distance.closest(q, e).collect()) == [("cot", "cat", 1), ("cot", "cut", 1), ("dag", "dog", 1)]


def test_stream(spark, tmp_path):
    from lexspark.streaming.text import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a b"), ("2024-01-01 00:20:00", "a b"), ("2024-01-01 05:00:00", "c")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["hist"], r["word"]): r["c"] for r in spark.table("windowed").collect() if r["word"] == "b"}
    assert got == {("", "b"): 2, ("a", "b"): 2}


def test_registry():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 60
