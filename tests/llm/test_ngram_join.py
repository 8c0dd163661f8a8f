import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from lexspark.llm.components import connected_components
from lexspark.llm.ngram_join import bands_for, deduplicated, least_agreement, near_duplicates, ngram_set, verified

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_of(text, n):
    """By the definition, with words and not with hashes."""
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n=5, t=0.8):
    sets = [grams_of(x, n) for _, x in docs]
    links, above = Counter(), list(range(len(docs)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= t * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = top(i), top(j)
            above[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d if d is not None else -1, low.get(top(i), -1), links[i]) for i, (d, _) in enumerate(docs))


def test_against_brute_force(documents):
    rng = random.Random(2)
    docs = []
    for g in range(8):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)]
        for _ in range(rng.choice((1, 2, 6, 20))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                w[rng.randrange(60)] = "new" + str(rng.randint(0, 9))
            docs.append((len(docs), " ".join(w)))
    docs += [(900, None), (901, ""), (902, "!!!"), (903, "only three words"), (904, "Only three words!"), (None, docs[0][1])]
    for block in (256, 4):  # groups in one piece, and cut into blocks
        got = near_duplicates(documents(*docs), block=block).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"] if r["class_id"] is not None else -1, r["n_links"]) for r in got) == brute(docs)


def test_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (3, 5)} == {3} and {r["n_links"] for r in got if r["doc_id"] == 5} == {2}
    assert near_duplicates(empty).count() == 0
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]


def test_bands():
    bands, rows = bands_for(0.8, 0.99999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.99999


def test_verified_is_exact():
    rng = np.random.default_rng(0)
    grams = [np.unique(rng.integers(0, 50, 40).astype(np.uint64)) for _ in range(24)]
    every = list(combinations(range(24), 2))
    for pairs in (every, every[:40]):  # by products, and one by one
        i, j = map(np.array, zip(*pairs, strict=True))
        want = [len(set(grams[x].tolist()) & set(grams[y].tolist())) >= 0.6 * len(set(grams[x].tolist()) | set(grams[y].tolist())) - 1e-9 for x, y in pairs]
        assert verified(grams, i, j, 0.6).tolist() == want


def test_least_agreement():
    k = least_agreement(88, 0.8, 1e-6)
    assert 45 < k < 60 and least_agreement(88, 0.8, 0.0) == 0


def test_rows_are_removed_and_not_ids(documents):
    """An id that different texts share, copies without an id, and equal rows."""
    copy = " ".join(f"c{i}" for i in range(30))
    docs = [(1, copy), (3, copy), (3, "a text of its own that shares only its id"), (None, copy), (None, "x y z"), (None, "x y z"), (7, "the same row"), (7, "the same row"), (8, None), (8, None), (9, "")]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in deduplicated(documents(*docs)).collect())
    assert kept == sorted([(1, copy), (3, docs[2][1]), (0, "x y z"), (7, "the same row"), (8, ""), (8, ""), (9, "")])


def test_a_long_chain_and_negative_ids(documents):
    """Each text is near the next one only: no unit holds the chain, the class does."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i - 50, " ".join(words[2 * i : 2 * i + 60])) for i in range(100)]
    for block in (512, 3):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents(*docs), block=block).collect()}
        want = {d: (c, n) for d, c, n in brute(docs)}
        assert got == want and {c for c, _ in got.values()} == {-50}


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (None, 4), (20, 10), (10, 30), (30, 25), (2, 1)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    assert sorted((r["node"], r["root"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (10, 10), (20, 10), (25, 10), (30, 10)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a bigint, b bigint")
    assert {r["root"] for r in connected_components(chain, "a", "b").collect()} == {0}
