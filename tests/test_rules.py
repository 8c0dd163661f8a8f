"""Transducers, context-dependent rewriting, grammars, pushdown rules, morphology."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.operators import fst, grammar, morphology, pushdown, rules
from lexspark.operators.cdrewrite import cdrewrite
from lexspark.operators.fst import accep, closure, compose, concat, cross, difference, equivalent, invert, optimize, paths, text_of, union
from pyspark.sql import functions as F

ABC = closure(union("a", "b", "c"))
WORD = st.text("abc", max_size=4)


def outputs(rule, text):
    return sorted({text_of(o) for _, o, _ in paths(compose(accep(text), rule))})


def naive(phi, psi, left, right, text, direction, mode):
    if direction == "rtl":
        return sorted(x[::-1] for x in naive([p[::-1] for p in phi], psi[::-1], right[::-1], left[::-1], text[::-1], "ltr", mode))
    found = set()

    def go(i, out):
        before = text[:i] if direction == "sim" else out
        live = [p for p in phi if text.startswith(p, i) and text.startswith(right, i + len(p))] if before.endswith(left) else []
        for p in live:
            go(i + len(p), out + psi)
        if not live or mode == "opt":
            if i == len(text):
                found.add(out)
            else:
                go(i + 1, out + text[i])

    go(0, "")
    return sorted(found)


@pytest.mark.parametrize("direction", ["ltr", "rtl", "sim"])
@pytest.mark.parametrize("mode", ["obl", "opt"])
def test_cdrewrite_against_naive(direction, mode):
    rng = random.Random(direction + mode)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    for _ in range(25):
        phi, psi, left, right = list({word(1, 2) for _ in range(2)}), word(0, 2), word(0, 2), word(0, 2)
        rule = cdrewrite(cross(union(*phi), psi), left, right, ABC, direction, mode)
        for _ in range(8):
            text = word(0, 7)
            assert outputs(rule, text) == naive(phi, psi, left, right, text, direction, mode), (phi, psi, left, right, text)


def test_cdrewrite_edges():
    assert outputs(cdrewrite(("a", "b"), "[BOS]", "", ABC), "aaca") == ["baca"]
    assert outputs(cdrewrite(("a", "b"), "", "[EOS]", ABC), "aaca") == ["aacb"]
    assert outputs(cdrewrite(("", "c"), "a", "b", ABC), "abab") == ["acbacb"]
    weighted = fst.arcmap(accep("a"), "times", 1.0)
    with pytest.raises(ValueError):
        cdrewrite(("a", "b"), weighted, "", ABC)
    with pytest.raises(ValueError):
        cdrewrite(("a", "b"), "", "", ABC, "up")


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=5), st.lists(WORD, min_size=1, max_size=5))
def test_languages_are_sets(a, b):
    x, y = union(*a), union(*b)
    words = lambda f: {text_of(o) for _, o, _ in paths(f)}
    assert words(optimize(union(x, y))) == set(a) | set(b)
    assert words(fst.intersect(x, y)) == set(a) & set(b)
    assert words(difference(x, y)) == set(a) - set(b)
    assert words(concat(x, y)) == {p + q for p in a for q in b}
    assert words(fst.reverse(x)) == {p[::-1] for p in a}
    assert equivalent(invert(invert(cross(x, y))), cross(x, y))
    assert optimize(x).num_states() <= fst.rmepsilon(x).num_states()


def test_paths_weights_and_repetition():
    lattice = union(accep("a", 2.0), accep("b", 1.0), accep("a", 0.5))
    assert [(text_of(o), w) for _, o, w in fst.best_paths(lattice, 3, True)] == [("a", 0.5), ("b", 1.0)]
    assert equivalent(closure("a", 1, 3), union("a", "aa", "aaa"))
    with pytest.raises(ValueError):
        closure("a", 3, 1)
    with pytest.raises(ValueError):
        list(paths(closure("a")))
    assert text_of(fst.randgen(accep("abc"))[0][1]) == "abc"
    assert fst.shortest_path(lattice).string() == "a" and fst.prune(lattice, 0.1).num_arcs() == 2
    assert fst.leniently_compose(ABC, cross("a", "b"), ABC) is not None
    assert outputs(fst.leniently_compose(ABC, cross("a", "b"), ABC), "c") == ["c"] and outputs(fst.leniently_compose(ABC, cross("a", "b"), ABC), "a") == ["b"]


def test_strings_and_maps():
    assert fst.labels_of("a[32][0x41]\\[") == [97, 32, 65, 91]
    assert fst.escape("a[b]") == "a\\[b\\]" and accep(fst.escape("a[b]")).string() == "a[b]"
    with pytest.raises(ValueError):
        accep("[a")
    assert rules.top_rewrite("dog", fst.string_map([("dog", "chien"), ("cat", "chat", 2.0)])) == "chien"
    with fst.default_token_type("utf8"):
        assert accep("é").num_arcs() == 1


def test_rewriting_api(spark):
    rule = union(cross("a", "x"), rules.add_weight(cross("a", "y"), 1.0), cross("a", "z"))
    assert rules.optimal_rewrites("a", rule) == ["x", "z"] and rules.matches("a", "y", rule)
    assert {x for x, _ in rules.rewrites("a", rule)} == {"x", "y", "z"} and len(rules.top_rewrites("a", rule, 2)) == 2
    with pytest.raises(rules.RewriteError):
        rules.one_top_rewrite("a", rule)
    with pytest.raises(rules.RewriteError):
        rules.top_rewrite("b", rule)
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string")
    assert [r["rewritten"] for r in rules.apply(df, "s", rule).collect()] == ["x", None, None, "x"]
    assert rules.matching(df, "s", rule).count() == 2
    made = rules.Cascade([cross("a", "b"), cross("b", "c")])
    assert [r["rewritten"] for r in rules.apply(df, "s", made).collect()] == ["c", None, None, "c"]


def test_grammar():
    text = """
    # comment
    import 'lib' as lib;
    func Opt[x] { return x?; }
    digit = ("1" : "one") | ("2" : "two") | ("3" : "three" <2>);
    export NUM = digit (" " : "-") digit;
    export OPT = Opt["a"] lib.B;
    export NO = ("a" | "b") - "b";
    ok = AssertEqual["a" | "b", "b" | "a"];
    """
    made = grammar.compile_grammar(text, lambda path: 'B = "b"; func F[x] { return x x; }')
    assert grammar.try_rules(made, ["NUM"], "1 3") == [("one-three", 2.0)]
    assert rules.top_rewrite("b", made["OPT"]) == "b" and rules.top_rewrite("ab", made["OPT"]) == "ab"
    cases = [{"rule": ["NO"], "input": "b"}, {"rule": ["NO"], "input": "a", "output": ["a"]}, {"rule": ["NUM"], "input": "1 2", "output": ["x"]}]
    assert grammar.cases_hold(made, cases) == [True, True, False]
    with pytest.raises(grammar.GrammarError):
        grammar.compile_grammar("x = y;")
    with pytest.raises(grammar.GrammarError):
        grammar.compile_grammar('x = AssertNull["a"];')


def test_pushdown():
    push, pop = fst.symbol("(1"), fst.symbol(")1")
    arc = lambda i, o: fst.Fst(0, (((i, o, 0.0, 1),), ()), {1: 0.0})
    rule = concat(closure(concat("a", arc(push, push))), closure(concat("b", arc(pop, pop))))
    accepted = [x for x in ("", "ab", "aabb", "aab", "ba", "aaabbb") if pushdown.compose_with(accep(x), rule, [(push, pop)]).start >= 0]
    assert accepted == ["", "ab", "aabb", "aaabbb"]


def test_morphology(spark):
    number = morphology.Feature("num", ("sg", "pl"))
    noun = morphology.Category.of(number)
    v = morphology.FeatureVector.of
    p = morphology.Paradigm("noun", noun, [(morphology.stem_plus(""), v(noun, "num=sg")), (morphology.stem_plus("s"), v(noun, "num=pl"))], ["cat", "dog"])
    assert rules.top_rewrite("cats", p.analyzer) == "cat+s[num=pl]" and rules.top_rewrite("dogs", p.lemmatizer) == "dog[num=pl]"
    assert v(noun, "num=sg").unify(v(noun, "num=pl")) is None and v(noun).unify(v(noun, "num=pl")) == v(noun, "num=pl")
    assert len(v(noun).values()) == 2
    with pytest.raises(ValueError):
        v(noun, "num=du")
    words = spark.createDataFrame([("cat",)], "stem string")
    assert {r["form"] for r in morphology.inflect(words, p).collect()} == {"cat", "cats"}
    child = morphology.Paradigm("en", noun, [(morphology.stem_plus("en"), v(noun, "num=pl"))], ["ox"], p)
    assert {r[2] for r in child.rows()} == {"ox", "oxen"}
    maps = spark.createDataFrame([({"a": "1"}, {"b": "2"}), ({"a": "1"}, {"a": "2"})], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in maps.select(morphology.unified()).collect()] == [{"a": "1", "b": "2"}, None]


def test_lowering(spark):
    from lexspark.plans.lowering import lowered

    assert lowered(F.lit("x"), ["ab"], "c") is None and lowered(F.lit("x"), ["a"], "b", left="b") is None
    df = spark.createDataFrame([("xaab.a",)], "s string")
    assert df.select(lowered(F.col("s"), ["a"], "$", left="x")).first()[0] == "x$ab.a"
