import random
import re

import numpy as np
from lexspark.llm.decontamination import blocks_of, contamination, decontaminated, without_spans
from lexspark.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, bench, width):
    low = lambda s: WORD.findall((s or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in bench:
        w = low(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = low(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items |= own
        out.append((doc, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_index_parts():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 9, 500)
    w = WaveletMatrix(seq, 8)
    at = np.arange(len(seq))
    assert (w.access(at)[0] == seq).all()
    for c in range(9):
        low = w.descend(np.full(1, c), np.array([0]))
        assert w.descend(np.full(1, c), np.array([400])) - low == (seq[:400] == c).sum()
    order = suffix_array(np.concatenate([seq + 1, [0]]))
    text = [*seq.tolist(), -1]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    runs = np.array([3, 1, 2, 3, 1, 0, 1, 2, 0])
    index = FMIndex(runs, np.array([0, 6]), 3, every=4)
    low, high = index.search(np.array([[1, 2], [0, 3], [2, 1]]), np.array([2, 1, 2]))
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [1, 6]
    assert sorted(index.locate(np.arange(low[1], high[1])).tolist()) == [0, 3]
    assert low[2] >= high[2]


def test_against_brute_force(documents, spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcde") + rng.choice(["", ",", "!"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, "")]
    bench = [(i, text(n)) for i, n in enumerate((0, 1, 2, 4, 5, 9, 9))] + [(7, None), (None, "a b c d")]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    want = brute(docs, [b for b in bench if b[0] is not None], 4)
    for block in (1 << 20, 160):  # in one block, and block by block
        got = contamination(documents(*docs), table, width=4, block_bytes=block).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in got) == want
        kept = decontaminated(documents(*docs), table, width=4, block_bytes=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, *_, bad in want if not bad)
        cut = {r["doc_id"]: r["text"] for r in decontaminated(documents(*docs), table, width=4, block_bytes=block, cut=True).collect()}
        spans = {r["doc_id"]: r["spans"] for r in got}
        for d, text_before in docs:
            bad = next(x[-1] for x in want if x[0] == d)
            assert cut[d] == (without_spans(text_before, spans[d]) if bad else text_before)


def test_a_long_item_is_dealt_to_several_blocks(documents, spark):
    words = [f"w{i}" for i in range(400)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:120]))], "item_id bigint, text string")
    assert len(blocks_of(table, 13, 2_000)) > 5
    got = contamination(documents((1, "x " + " ".join(words[90:130]) + " y"), (2, " ".join(words[:12]))), table, block_bytes=2_000).collect()
    assert [(r["n_hit"], r["spans"], r["items"]) for r in got] == [(40, [(1, 41)], [1, 2]), (0, [], [])]


def test_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "one line two lines"), (2, "never seen here at all")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in contamination(odd, bench, width=4).collect()}
    assert got[1]["n_words"] == 0 and got[2]["n_words"] == 0 and got[4]["n_words"] == 40_000
    assert got[3]["spans"] == [(0, 4)] and got[3]["contaminated"] and not got[None]["contaminated"]
    kept = decontaminated(odd, bench, width=4)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 6]
    assert contamination(empty, bench).count() == 0
    assert contamination(odd, bench.where("item_id > 9")).where("contaminated").count() == 0


def test_spans_cut_text():
    assert without_spans("Keep, One two! three keep", [(1, 4)]) == "Keep,  keep"
