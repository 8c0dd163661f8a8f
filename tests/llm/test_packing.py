import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexspark.llm.packing import _searched_in_tasks, best_fit, levels, local_search, pack, plan
from lexspark.llm.pretokens import Vocabulary, public_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_holds_every_piece(sizes):
    counts = Counter(sizes)
    groups = plan(dict(counts), 30)
    held = Counter()
    for content, n in groups:
        assert sum(k * m for k, m in content) <= 30
        for k, m in content:
            held[k] += m * n
    assert held == counts
    assert sum(n for _, n in groups) <= best_fit(dict(counts), 30).total()


def test_local_search_helps():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in bins of 10
    assert sum(n for _, n in plan(counts, 10)) == 4


def test_local_search_has_no_limit_of_steps():
    """Many equal pieces that best fit wastes room on: thousands of steps, each of which keeps every piece."""
    rng = np.random.default_rng(4)
    counts = dict(Counter(rng.integers(40, 1900, 4_000).tolist()) + Counter({330: 3_456, 331: 512}))
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    bins = best_fit(counts, 2048)
    before = bins.total()
    steps = local_search(bins, least)
    assert steps > 100 and least <= bins.total() <= before
    held = Counter()
    for content, n in bins.groups():
        assert sum(k * m for k, m in content) <= 2048
        for k, m in content:
            held[k] += m * n
    assert held == counts


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 5000)), unique_by=lambda x: x[0], max_size=12))
def test_levels_hold_every_bin(groups):
    groups = [(((k, 1),), n) for k, n in groups]
    held = Counter()
    for scale, level in levels(groups, 8):
        for content, n in level:
            assert 0 < n < 8
            held[content] += n * scale
    assert held == dict(groups)


def test_levels_lose_no_bins():
    """The search by levels ends where the search over all bins at once does, but for one in a thousand."""
    rng = np.random.default_rng(1)
    counts = dict(Counter(rng.integers(500, 1001, 2_500).tolist()))
    bins = best_fit(counts, 2048)
    local_search(bins, 0)
    assert sum(n for _, n in plan(counts)) <= bins.total() * 1.001 + 1


def test_cost_follows_lengths(spark):
    """Two hundred million pieces of ten lengths, searched in tasks as in this process."""
    counts = {k: 20_000_000 + k for k in range(505, 1000, 50)}
    groups = plan(counts, 2048, _searched_in_tasks(spark))
    assert groups == plan(counts)
    held = Counter()
    for content, n in groups:
        assert sum(k * m for k, m in content) <= 2048
        for k, m in content:
            held[k] += m * n
    assert held == counts
    assert sum(n for _, n in groups) <= best_fit(counts, 2048).total()


def check(rows, texts, capacity):
    vocabulary = Vocabulary(public_path())
    ids = [(np.array([*vocabulary.whole(t or ""), 0], dtype="<u4")) for t in texts]
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, whole in enumerate(ids):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(whole)
        assert all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_round_trip(documents):
    texts = [None, "", "a b c", "word " * 50, "Déjà vu, 日本! <|endoftext|>  \n\n x", "word " * 50, "1 2 3 4 5 6 7 8 9"]
    rows = pack(documents(*enumerate(texts)), capacity=16).collect()
    n = check(rows, texts, 16)
    assert n == -(-sum(r["length"] for r in rows) // 16)


def test_odd_rows(odd, empty):
    rows = pack(odd).collect()
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and any(r["doc_id"] is None for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pack(empty).count() == 0


def test_writes_the_pieces_alone(spark, documents, tmp_path, monkeypatch):
    """Counts of lengths aren't a table: under many shuffle partitions they would be as many files of a few numbers."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr("lexspark.tables.shared_dir", lambda _: f"file://{tmp_path}")
    before = {k: spark.conf.get(k, None) for k in settings}
    texts = ["word " * n for n in range(60)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = pack(documents(*enumerate(texts)).repartition(3), capacity=16).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    check(rows, texts, 16)
    assert {p.parent.name.split("-")[0] for p in tmp_path.rglob("part-*.parquet")} == {"pieces"}
    assert len(list(tmp_path.rglob("part-*.parquet"))) <= 3


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n b", "don't  we'll", " x", "x ", "\n\n", "ab　cd", "<|endoftext|>", "a<|endoftext|> b", "\x1c a", "日本 x", "2²³ a"])
def test_vocabulary_equals_the_library(text):
    v = Vocabulary(public_path())
    want = v.whole(text)
    assert np.frombuffer(v.encode(text), "<u4").tolist() == want
    assert sum(map(v.count, v.split(text))) == len(want)
