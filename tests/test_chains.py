"""Models as chains, two models at once, sampling by joins and removal one by one, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.operators import chains, counting, merging, sampling, scoring, shrinking, smoothing
from lexspark.operators.greedy import price, removals

ONE = ["a b a", "b b c", "a c", "", "c a b a b", "b"]
TWO = ["a b", "d a b a", "c c d", "b a", "a b c d"]


def model(spark, texts, order):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return smoothing.witten_bell(counting.count(rows, order), order)


class Table:
    """A model as dictionaries, for brute force."""

    def __init__(self, m):
        self.p = {(tuple(r["hist"].split()), r["word"]): r["p"] for r in m.grams.collect()}
        self.alpha = {tuple(r["hist"].split()): r["alpha"] for r in m.backoffs.collect()}
        self.words = sorted({w for h, w in self.p if not h})
        self.order = m.order

    def prob(self, hist, word):
        if (hist, word) in self.p:
            return self.p[hist, word]
        return self.alpha.get(hist, 1.0) * self.prob(hist[1:], word) if hist else 0.0

    def chain(self, histories, reentry):
        states = sorted(histories)
        at = {h: k for k, h in enumerate(states)}
        moves = np.zeros((len(states), len(states)))
        for h in states:
            for w in self.words:
                to = ("<s>",) if w == "</s>" else (*h, w)[-(self.order - 1) :]
                while to not in at:
                    to = to[1:]
                moves[at[h], at[to]] += self.prob(h, w) * (reentry if w == "</s>" else 1)
        return states, moves


@pytest.mark.parametrize("order", [2, 3])
def test_stationary_histories(spark, order):
    m = model(spark, ONE, order)
    t = Table(m)
    states, moves = t.chain({(), *t.alpha}, chains.REENTRY)
    x = np.array([{tuple(r["hist"].split()): r["ph"] for r in scoring.history_probability(m).collect()}[h] for h in states])
    x /= x.sum()
    got = lambda df: np.array([{tuple(r["hist"].split()): r["ph"] for r in df.collect()}[h] for h in states])
    few = got(chains.stationary_histories(m, rounds=3, eps=0.0))
    assert np.allclose(few, x @ np.linalg.matrix_power(moves, 3), atol=1e-12)
    if order == 2:
        settled = got(scoring.history_probability(m, stationary=True))
        assert np.allclose(settled, x @ np.linalg.matrix_power(moves, 200), rtol=0.02, atol=1e-4)


def test_two_models(spark):
    order = 3
    a, b = model(spark, ONE, order), model(spark, ONE + TWO, order)
    ta, tb = Table(a), Table(b)
    both = merging.joint(a, b)
    rows = both.grams.collect()
    assert len(rows) == len({*ta.p, *tb.p})
    for r in rows:
        h = tuple(r["hist"].split())
        pa, pb = ta.prob(h, r["word"]), tb.prob(h, r["word"])
        assert math.isclose(r["p1"] or 0.0, pa, rel_tol=1e-9) and math.isclose(r["p2"] or 0.0, pb, rel_tol=1e-9)
        assert r["in1"] == ((h, r["word"]) in ta.p) and r["in2"] == ((h, r["word"]) in tb.p)
    # Entropy: expected visits of each history of either model, by linear algebra, and all words of each.
    states, moves = ta.chain({(), *ta.alpha, *tb.alpha}, 0.0)
    visits = np.linalg.solve((np.eye(len(states)) - moves).T, np.eye(len(states))[states.index(("<s>",))])
    h = sum(v * -ta.prob(s, w) * math.log(tb.prob(s, w)) for s, v in zip(states, visits, strict=True) for w in ta.words)
    got = chains.cross_entropy(a, b, eps=1e-4).first()
    assert math.isclose(got["entropy"], h, rel_tol=1e-3) and math.isclose(got["symbols"], visits.sum(), rel_tol=1e-3)
    assert math.isclose(got["perplexity"], math.exp(h / visits.sum()), rel_tol=1e-3)
    assert chains.cross_entropy(b, a, rounds=1).first()["entropy"] == math.inf  # a has no word d
    # The product, and its share of each history.
    whole = Table(chains.intersected(a, b, normalise=False))
    part = Table(chains.intersected(a, b))
    for s in {(), *ta.alpha, *tb.alpha}:
        if len(s) < order:
            z = sum(ta.prob(s, w) * tb.prob(s, w) for w in ta.words)
            for w in ta.words:
                assert math.isclose(whole.prob(s, w), ta.prob(s, w) * tb.prob(s, w), rel_tol=1e-9)
            assert math.isclose(sum(part.prob(s, w) for w in part.words), 1.0, rel_tol=1e-6) or z == 0
            for w in part.words:
                if (s, w) in part.p:
                    assert math.isclose(part.prob(s, w), whole.prob(s, w) / z, rel_tol=1e-9)


def test_orders_are_compared_first(spark):
    with pytest.raises(ValueError):
        merging.merge_models(model(spark, ONE, 2), model(spark, ONE, 1))


def test_sampled_words_follow_the_model(spark):
    m = model(spark, ONE, 3)
    t, n = Table(m), 3_000
    words = sorted(sampling.draws(spark, m, n, 5, 2).collect(), key=lambda r: (r["id"], r["pos"]))
    texts: dict = {}
    for r in words:
        texts.setdefault(r["id"], []).append(r["word"])
    assert len(texts) == n
    hist: dict = {}
    for seq in texts.values():
        for k, w in enumerate(seq):
            hist.setdefault(("<s>", *seq[:k])[-2:], Counter())[w] += 1
    for h, c in hist.items():
        total = sum(c.values())
        for w in t.words:
            p = t.prob(h, w)
            assert abs(c[w] / total - p) < 5 * math.sqrt(p * (1 - p) / total) + 1e-9, (h, w)


def test_sentences(spark):
    m = model(spark, ONE, 2)
    a = sorted(map(tuple, sampling.sentences(spark, m, 40, 3, 3).collect()))
    assert a == sorted(map(tuple, sampling.sentences(spark, m, 40, 3, 3).collect())) and len(a) == 40
    assert all(len(t.split()) <= 3 and set(t.split()) <= {"a", "b", "c"} for _, t in a)
    unigrams = sampling.sentences(spark, model(spark, ONE, 1), 10, 1, 2)
    assert unigrams.count() == 10


def test_long_lines_are_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET", 3)
    m = model(spark, ["w%d w%d" % (i, i * 7 % 50) for i in range(50)], 2)
    heads, cells = sampling.lines(m)
    masses = {r["hist"]: r["mass"] for r in heads.collect()}
    spans: dict = {}
    for r in cells.collect():
        spans.setdefault(r["hist"], set()).add((r["lo"], r["hi"]))
    for h, own in spans.items():
        at = 0.0
        for lo, hi in sorted(own):
            assert abs(lo - at) < 1e-9
            at = hi
        assert abs(at - masses[h]) < 1e-9


def one_by_one(p, q, n, a, b, most):
    p, q, own = np.repeat(p, n), np.repeat(q, n), np.repeat(np.arange(len(n)), n)
    live, gone = np.ones(len(p), bool), np.zeros(len(n), int)
    while live.any():
        at = np.flatnonzero(live)
        cost = np.array([price(x, y, a, b) for x, y in zip(p[at].tolist(), q[at].tolist(), strict=True)])
        if cost.min() > most:
            break
        k = at[np.flatnonzero(cost == cost.min()).max()]
        live[k] = False
        gone[own[k]] += 1
        a, b = a + p[k], b + q[k]
    return gone


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.floats(-7, -1))
def test_the_queue_takes_what_a_plain_loop_takes(seed, size):
    r = np.random.default_rng(seed)
    m = int(r.integers(1, 40))
    n = r.integers(1, 4, m)
    w, v = (r.dirichlet(np.ones(m + 1) * r.choice([0.3, 1, 5])) for _ in range(2))
    p, q = w[:m] / n * 0.999 + 1e-9, v[:m] / n * 0.999 + 1e-9
    a, b = 1 - float((p * n).sum()), 1 - float((q * n).sum())
    assert (removals(p, q, n, a, b, 10**size) == one_by_one(p, q, n, a, b, 10**size)).all()


def test_a_history_of_very_many_words():
    """A million words whose counts repeat, as counts do: their classes are few."""
    r = np.random.default_rng(1)
    c, d = r.zipf(1.5, 10**6).clip(1, 10**5).astype(float), r.zipf(1.5, 10**6).clip(1, 1_000).astype(float)
    classes, n = np.unique(np.stack([(c - 0.6) / c.sum() * 0.7, d / d.sum() * 0.9], axis=1), axis=0, return_counts=True)
    a, b = 1 - float((classes[:, 0] * n).sum()), 1 - float((classes[:, 1] * n).sum())
    gone = removals(classes[:, 0], classes[:, 1], n, a, b, 1e-12)
    assert 0 < gone.sum() < 10**6 and (gone <= n).all()


@pytest.mark.parametrize("order", [2, 3])
def test_greedy_of_a_model(spark, order):
    m = model(spark, (ONE + TWO) * 2, order)
    theta = 0.004
    rows = {(r["hist"], r["word"]): r for r in shrinking._scored(m).collect()}
    gone, above = set(), set()
    for n in range(order, 1, -1):
        needed = {(" ".join(h.split()[1:]), w) for h, w in above} | {(" ".join(h.split()[:-1]), h.split()[-1]) for h, w in above}
        own = {k: r for k, r in rows.items() if r["ord"] == n}
        for h in {h for h, _ in own}:
            free = sorted((w for x, w in own if x == h and (h, w) not in needed))
            if not free:
                continue
            first = own[h, free[0]]
            if first["num"] <= 0 or first["den"] <= 0:
                continue  # nothing is backed off, so nothing can be compared
            k = [own[h, w] for w in free]
            # Words with the same p and q form classes; of a class the last words go.
            pairs = sorted({(x["p"], x["q"]) for x in k}, key=lambda c: max(x["word"] for x in k if (x["p"], x["q"]) == c))
            members = [sorted(x["word"] for x in k if (x["p"], x["q"]) == c) for c in pairs]
            got = one_by_one(np.array([c[0] for c in pairs]), np.array([c[1] for c in pairs]), np.array([len(x) for x in members]), first["num"], first["den"], theta / first["ph"] if first["ph"] else math.inf)
            gone |= {(h, w) for x, g in zip(members, got, strict=True) for w in x[len(x) - g :]}
        above = {k for k in own if k not in gone}
    left = shrinking.greedy(m, theta)
    assert gone and {(r["hist"], r["word"]) for r in left.grams.collect()} == {(r["hist"], r["word"]) for r in m.grams.collect()} - gone
    assert smoothing.topology_faults(left.grams).count() == 0
