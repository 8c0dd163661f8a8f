import math
import re
import zlib
from collections import Counter

import numpy as np
from lexspark.llm.quality import Features, fit, graded, kept, score, selected, shape, train
from pyspark.sql import functions as F


def planted(n):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 40))
        grade = i % 3
        if grade < 2:
            text += " vile rotten" if i % 2 else " vile nasty"
        if grade < 1:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, grade))
    return rows


def test_held_out_accuracy(documents, spark):
    rows = planted(900)
    docs = documents(*((i, t) for i, t, _ in rows))
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows if i % 5], "doc_id bigint, quality int, toxic int")
    model = train(docs, graded(labels))
    got = {r["doc_id"]: r for r in score(docs, model).withColumn("keep", kept(F.col("tail"))).collect()}
    right = [got[i]["keep"] == (g == 2) for i, _, g in rows if i % 5 == 0]
    assert np.mean(right) > 0.95
    assert model.thresholds[0] < model.thresholds[1]
    again = train(docs, graded(labels))
    assert np.allclose(again.weights, model.weights) and np.allclose(again.thresholds, model.thresholds)
    assert 0 < selected(docs, model).count() < 900 and selected(docs, model).columns == docs.columns


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = train(odd, graded(labels))
    assert score(odd, model).count() == odd.count() and score(empty, model).count() == 0
    none = train(odd, graded(labels.where("doc_id > 99")))
    assert none is None and selected(odd, none).count() == odd.count()
    assert score(odd, none).where("tail is null").count() == odd.count()


def brute_score(text, model):
    """Words and marks by the docstring, one at a time, and the tails of the cumulative-link model."""
    mask = (1 << model.bits) - 1
    place = lambda x: zlib.crc32(x) & mask
    raw = (text or "").encode()
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    total = sum(0.5 * float(model.weights[place(w)]) for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", low)))
    marks = Counter(place(b"\0" + shape(t)) for t in tokens)
    same = sum(tokens[i] == tokens[i + 1] for i in range(len(tokens) - 1))
    if same:
        marks[place(b"\0again" + str(min(9, 10 * same // len(tokens))).encode())] += 1
    norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in marks.values()))
    total += sum((1 + math.log(n)) / norm * float(model.weights[k]) for k, n in marks.items())
    tails = [1 / (1 + math.exp(-(total - b))) for b in model.thresholds]
    return sum(tails), tails[-1]


def test_scores_against_brute_force(documents, spark):
    rows = planted(300)
    long = " ".join(f"W{i}!! {'x' * (i % 90)}-{i}" for i in range(3_000))
    docs = documents(*((i, t) for i, t, _ in rows), (900, None), (901, ""), (902, long), (903, "a a a a b"), (904, "日本語 Déjà-vu " + "y" * 5_000))
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows], "doc_id bigint, quality int, toxic int")
    model = train(docs, graded(labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score(docs, model).collect():
        want = brute_score(texts[r["doc_id"]], model)
        assert math.isclose(r["expected_grade"], want[0], rel_tol=1e-6) and math.isclose(r["tail"], want[1], rel_tol=1e-6)


def test_fit_is_a_maximum_of_the_likelihood():
    """No small change of a weight or threshold makes the ratings likelier (less the penalty)."""
    rng = np.random.default_rng(1)
    n, decay = 400, 1e-2
    places = [np.array([i % 5, 5 + i % 3]) for i in range(n)]
    values = [np.ones(2) for _ in range(n)]
    grades = np.array([min(2, max(0, round((i % 5) / 2 + rng.normal(0, 0.7)))) for i in range(n)])
    model = fit(places, values, grades, 4, 2, rounds=4_000, decay=decay, screen=0.0)
    weight = ((n / np.maximum(np.bincount(grades, minlength=3), 1)) ** 0.25)[grades]
    weight /= weight.mean()

    def value(w, b):
        score = np.array([w[p].sum() for p in places])
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(score[:, None] - b[None, :]))), np.zeros((n, 1))], axis=1)
        p = tail[np.arange(n), grades] - tail[np.arange(n), grades + 1]
        return (weight * np.log(p)).mean() - decay * (w**2).sum() / 2

    w, b = model.weights.astype(float), model.thresholds
    best = value(w, b)
    for k in range(10):
        change = np.eye(16)[k if k < 8 else 0] * 0.05 * (k < 8)
        step = np.eye(2)[k - 8] * 0.05 if k >= 8 else np.zeros(2)
        assert value(w + change, b + step) <= best + 1e-5 and value(w - change, b - step) <= best + 1e-5


def test_the_sample_is_bounded(documents, spark):
    """An id that many rows and ratings share, and a text beyond the bound."""
    docs = documents(*[(1, f"same id {i}") for i in range(50)], (2, "z " * 600), (3, "other"))
    labels = spark.createDataFrame([(1, 1, 0)] * 20 + [(2, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert train(docs, graded(labels), most_rows=10, most_bytes=1_000) is not None
    assert train(docs.where("doc_id = 2"), graded(labels), most_bytes=1_000) is None


def test_whole_tokens_are_read():
    assert shape(b"a" * 100 + b"1" * 3 + b"!") == b"a0!" and shape(b"-" * 90) == b"----" and shape(b"a-1-b-2-c-3-d#") == shape(b"a-1-b-2-c-3-d-4-e#")


def test_parts():
    assert shape(b"Word***") == b"a***" and shape(b"WORD!!") == b"A!!" and shape(b"12ab") == b"0a"
    places, values = Features(12).of(None)
    assert len(places) == 0 and len(values) == 0
    model = fit([], [], np.zeros(0, dtype=np.int64), 8, 2)
    assert model.tails(np.zeros(1)).shape == (1, 2)
