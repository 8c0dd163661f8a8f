"""Rule cases, ARPA files in parts, and distances with costs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.operators import counting, rules, smoothing
from lexspark.operators.cdrewrite import cdrewrite
from lexspark.operators.distance import distance, distances, with_distance
from lexspark.operators.fst import closure, concat, cross, union
from lexspark.sources import arpa, cases

ANY = closure(rules.BYTE)
FILE = r"""# a comment with rewrite { in it
comment: "of the file"

rewrite {
  comment: "both outputs"  # input: "no"
  rule: "OPT"
  input: "a#b"
  output: "a#b"
  output: 'e#b'
}
rewrite {
  rule: "A" rule: "E"
  input: "na"
    "me"
  output: "nimi"
}

rewrite { rule: "ONLY" input: "x" }
rewrite {
  rule: "A"
  input: "caf\303\251 \"q\" a\n"
  output: "cef\303\251 \"q\" e\n"
}
rewrite { rule: "NONE" input: "a" output: "a" }
"""


@pytest.fixture(scope="module")
def registry():
    return rules.Registry({"A": cdrewrite(cross("a", "e"), "", "", ANY), "E": cdrewrite(cross("e", "i"), "", "", ANY), "OPT": cdrewrite(cross("a", "e"), "", "", ANY, mode="opt"), "ONLY": cross("y", "z")})


def test_cases_of_a_file(spark, tmp_path, registry):
    (tmp_path / "cases.textproto").write_text(FILE)
    found = cases.read(spark, str(tmp_path / "cases.textproto"))
    rows = {r["input"]: r for r in found.collect()}
    assert len(rows) == 5
    assert rows["a#b"]["comment"] == "both outputs" and rows["a#b"]["output"] == ["a#b", "e#b"]
    assert rows["name"]["rule"] == ["A", "E"] and rows["x"]["output"] == []
    assert rows['café "q" a\n']["output"] == ['cefé "q" e\n']
    held = {(r["rule"][0], r["input"]): (r["held"], r["error"]) for r in cases.tested(found, registry).collect()}
    assert held["OPT", "a#b"] == (True, None) and held["A", "name"] == (True, None)
    assert held["ONLY", "x"][0] and "fails" in held["ONLY", "x"][1]
    assert held["A", 'café "q" a\n'] == (True, None)
    assert not held["NONE", "a"][0] and "no rule" in held["NONE", "a"][1]


@pytest.mark.parametrize("mode,want", [("exact", [True, False, False, False, True]), ("one_top", [True, True, True, False, True]), ("subset", [True, True, False, False, True]), ("top", [True, True, False, False, True])])
def test_ways_to_compare(spark, mode, want):
    rows = [(0, ["a", "b"], ["a", "b"]), (1, ["a", "b"], ["a"]), (2, ["a", "b"], ["a", "c"]), (3, ["a"], []), (4, None, [])]
    df = spark.createDataFrame(rows, "k int, actual array<string>, output array<string>")
    assert [r["h"] for r in df.select("k", cases.held(df["actual"], df["output"], mode).alias("h")).orderBy("k").collect()] == want
    with pytest.raises(ValueError):
        cases.held(df["actual"], df["output"], "other")


def test_outputs_that_are_cut_off_are_told(spark):
    half = union(*(cross("a", x) for x in "bcdef"))
    rule = concat(*[half] * 3)
    every = rules.rewrites("aaa", rule)
    assert len(every) == 125
    df = spark.createDataFrame([("aaa",), ("b",), (None,)], "s string")
    found = {r["s"]: r for r in rules.apply(df, "s", rule, "out", "rewrites", error="why").collect()}
    assert len(found["aaa"]["out"]) == 125 and found["aaa"]["why"] is None
    assert found["b"]["out"] is None and "fails" in found["b"]["why"] and found[None]["why"] is None
    real = rules.lattice_to_dfa
    rules.lattice_to_dfa = lambda lattice: (real(lattice)[0], True)
    try:
        with pytest.raises(rules.Truncated) as e:
            rules.rewrites("aaa", rule)
        assert len(e.value.found) == 125
    finally:
        rules.lattice_to_dfa = real


def test_arpa_in_parts(spark, tmp_path):
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(60)]
    model = smoothing.witten_bell(counting.count(spark.createDataFrame([(t,) for t in texts], "text string"), 2), 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        arpa.write(model, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).split("\n")
    sizes = {n: model.grams.where(f"ord = {n}").count() for n in (1, 2)}
    marks = [x for x in lines if x.startswith("\\")]
    assert lines[:4] == ["", "\\data\\", f"ngram 1={sizes[1] + 1}", f"ngram 2={sizes[2]}"] and marks == ["\\data\\", "\\1-grams:", "\\2-grams:", "\\end\\"]
    one, two = lines.index("\\1-grams:"), lines.index("\\2-grams:")
    assert two - one - 2 == sizes[1] + 1 and lines.index("\\end\\") - two - 2 == sizes[2]
    again = arpa.read(spark, str(tmp_path / "m"))
    key = lambda m: {(r["hist"], r["word"]): round(r["p"], 4) for r in m.grams.collect()}
    assert key(again).keys() == key(model).keys()


TEXT = st.one_of(st.none(), st.text("abcé", max_size=8))
COST = st.sampled_from([0.0, 0.5, 1.0, 2.5])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=10), COST, COST, COST, st.sampled_from([None, 0.0, 1.0, 2.5]))
def test_distances_of_a_batch(pairs, insert, delete, substitute, bound):
    want = [None if a is None or b is None else distance(a, b, insert, delete, substitute, bound) for a, b in pairs]
    assert distances([a for a, _ in pairs], [b for _, b in pairs], insert, delete, substitute, bound) == pytest.approx(want)


def test_distances_of_a_column(spark):
    rows = [("kitten", "sitting"), ("", "abc"), (None, "x"), ("a" * 3_000, "a" * 2_999 + "b")]
    found = with_distance(spark.createDataFrame(rows, "a string, b string"), "a", "b", "d", 1.0, 2.0, 1.5).collect()
    assert [r["d"] for r in found] == [4.0, 3.0, None, 1.5]
