"""Queries over part take whole names and types, and all their words."""

import itertools
import math
from collections import defaultdict

import pytest
from lexspark import rule_queries

ROWS = [(1, "red band aha", "ECONOMY"), (2, "ab", "LARGEST")]


@pytest.fixture
def part(spark, tmp_path):
    spark.createDataFrame(ROWS, "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def expected_edits(x, y, p):
    """Expected edits of one pair over all its alignments, by sums over what precedes and follows each."""
    edits = lambda i, j: ((a, b) for a, b in ((x[i : i + 1], y[j : j + 1]), (x[i : i + 1], ""), ("", y[j : j + 1])) if a or b)
    ahead, after = defaultdict(float, {(0, 0): 1.0}), defaultdict(float, {(len(x), len(y)): 1.0})
    cells = list(itertools.product(range(len(x) + 1), range(len(y) + 1)))
    arcs = lambda i, j: {(a, b, i + len(a), j + len(b)) for a, b in edits(i, j)}
    for i, j in cells:
        for a, b, k, m in arcs(i, j):
            ahead[k, m] += ahead[i, j] * p[a, b]
    for i, j in reversed(cells):
        for a, b, k, m in arcs(i, j):
            after[i, j] += p[a, b] * after[k, m]
    out = defaultdict(float)
    for i, j in cells:
        for a, b, k, m in arcs(i, j):
            out[a, b] += ahead[i, j] * p[a, b] * after[k, m] / after[0, 0]
    return out


def normalised(n):
    sums = defaultdict(float)
    for (a, _), c in n.items():
        sums[a] += c
    return {k: c / sums[k[0]] for k, c in n.items() if sums[k[0]]}


def test_em_train(spark, part):
    pairs = [(n.lower(), t.lower()) for _, n, t in ROWS]
    letters = sorted({c for pair in pairs for x in pair for c in x})
    p = normalised({(a, b): 1.0 for a in [*letters, ""] for b in [*letters, ""] if a or b})
    for _ in range(2):
        total = defaultdict(float)
        for x, y in pairs:
            for k, c in expected_edits(x, y, defaultdict(float, p)).items():
                total[k] += c
        p = normalised(total)
    got = {(r["ilabel"], r["olabel"]): r["p"] for r in rule_queries.em_train(spark, part).collect()}
    assert {k for k, v in got.items() if v > 1e-12} == {k for k, v in p.items() if v > 1e-12}
    assert all(math.isclose(got[k], v, rel_tol=1e-6) for k, v in p.items() if v > 1e-12)


def test_optional_rule(spark, part):
    want = {(i, "".join(c)) for i, n, _ in ROWS for c in itertools.product(*(("a", "4") if c == "a" else (c,) for c in n))}
    assert {tuple(r) for r in rule_queries.speech_rule_optional(spark, part).collect()} == want


def test_lattice_counts(spark, part):
    got = {r["word"]: r["c"] for r in rule_queries.lattice_counts(spark, part).collect()}
    assert got == {"red": 0.333333, "band": 0.333333, "aha": 0.333333, "ab": 1.0, "</s>": 2.0}
