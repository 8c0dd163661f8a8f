import math
import zlib
from collections import Counter

import numpy as np
import pytest
from lexspark.llm.suffix_tree import grown, normalised, score, tokens
from lexspark.llm.terms import term_counts
from pyspark.sql import functions as F


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "The cat and the dog", None, "", "zebra   quiz\n x"] * 4


def test_base_and_held_out(documents):
    got = {r["doc_id"]: r for r in score(documents(*enumerate(TEXTS))).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(TEXTS))}
    counts = Counter(t for i, x in enumerate(TEXTS) if not out[i] for t in tokens((x or "").encode()))
    n, v = counts.total(), len(counts)
    for i, x in enumerate(TEXTS):
        own = tokens((x or "").encode())
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(own), sum(t in counts for t in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert term_counts(documents(*enumerate(TEXTS)), lambda: tokens).count() > 10


def test_odd_rows(odd, empty):
    got = score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert score(empty).count() == 0


def brute_tree(texts, depth, gain):
    """Counts of every context and next byte, and the contexts that the rule of the docstring keeps."""
    after = [Counter() for _ in range(depth + 1)]
    for x in texts:
        raw = b"\n" * depth + normalised((x or "").encode())
        if raw == b"\n" * (depth + 1):
            continue  # an empty text's end isn't learned
        for at in range(depth, len(raw)):
            for k in range(depth + 1):
                after[k][raw[at - k : at], raw[at]] += 1
    counts, successors = Counter(), Counter()
    for k in range(depth + 1):
        for (context, _), n in after[k].items():
            counts[context] += n
            successors[context] += 1
    kept = set()
    for k in range(1, depth + 1):
        gains = Counter()
        for (context, byte), n in after[k].items():
            below = after[k - 1][context[1:], byte] / counts[context[1:]]
            gains[context] += n * math.log(n / counts[context] / below)
        for context, value in gains.items():
            if counts[context] >= 2 and value >= gain:
                kept |= {context[j:] for j in range(k)}
    return after, counts, successors, kept


def brute_score(text, tree, depth):
    """log10 of the probability by the definition, one byte at a time, from the longest kept suffix down."""
    after, counts, successors, kept = tree

    def p(context, byte):
        if not context:
            return (after[0][b"", byte] + 0.5) / (counts[b""] + 128)
        below = p(context[1:], byte)
        if context not in kept:
            return below
        return (after[len(context)][context, byte] + successors[context] * below) / (counts[context] + successors[context])

    raw = b"\n" * depth + normalised((text or "").encode())
    return sum(math.log10(p(raw[at - depth : at], raw[at])) for at in range(depth, len(raw)))


@pytest.mark.parametrize(("depth", "gain"), [(2, 1.0), (4, 3.0), (5, 10.0)])
def test_learning_against_brute_force(documents, depth, gain):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcde"), size=rng.integers(1, 6))) for _ in range(25)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 20))) for _ in range(80)] + [None, "", "é Ü\tx"]
    _, kept, _ = grown(documents(*enumerate(texts)).select("text", F.lit(False).alias("held_out")), depth, gain=gain)
    got = {int(r["context"]).to_bytes(r["k"], "big") for r in kept.collect()}
    assert got == brute_tree(texts, depth, gain)[3] and len(got) > 5


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_scores_against_brute_force(documents, head):
    """Whatever part of the grams is sent out; rare contexts stay."""
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijkl"), size=7)) for _ in range(60)]
    texts = [*(f"{names[i % 60]} {names[(i * 7 + 1) % 60]} {names[i % 60]}" for i in range(300)), None, "", "a", "unseen \xe9 bytes", "the cat sat " * 60]
    train = [x for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    tree = brute_tree(train, 5, 10.0)
    got = {r["doc_id"]: r["score"] for r in score(documents(*enumerate(texts)), head=head).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [brute_score(x, tree, 5) for x in texts], rtol=1e-7) and len(tree[3]) > 100


def test_probabilities_of_a_context_sum_to_one():
    tree = brute_tree(["the cat sat on the mat", "the dog"] * 9, 3, 1.0)
    after, counts, successors, kept = tree
    for context in [b"", b"t", b"he ", b"zzz"]:
        total = 0.0
        for byte in range(256):
            p = (after[0][b"", byte] + 0.5) / (counts[b""] + 128)
            for k in range(1, len(context) + 1):
                c = context[-k:]
                p = (after[k][c, byte] + successors[c] * p) / (counts[c] + successors[c]) if c in kept else p
            total += p
        assert math.isclose(total, 1)


def test_the_bar_does_not_rise_with_the_corpus(documents):
    """A context met three times stays in 8 MB of other text, and the tree is a table of any size."""
    common = "the cat sat on the mat and the dog " * 2400
    docs = documents((1, "qz qz qz"), *((i + 2, common) for i in range(100)))
    _, kept, _ = grown(docs.select("text", F.lit(False).alias("held_out")), 1)
    assert ord("q") in {r["context"] for r in kept.collect()}
