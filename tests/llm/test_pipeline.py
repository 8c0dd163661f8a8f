import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import test_decontamination as decontamination
import test_line_templates as lines
import test_ngram_join as joined
import test_quality as quality
from lexspark.llm import queries
from lexspark.llm.quality import graded, train


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert now.keys() <= before.keys()
        if name != "line dedup":
            assert all(now[i] == before[i] for i in now)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before.keys()


def corpus():
    """Graded texts, near and exact copies, shared lines, passages of the benchmark; nulls, empty and very long texts, repeated rows."""
    rng = random.Random(8)
    texts = [(i, t, g) for i, t, g in quality.planted(240)]
    shared = "this whole line of plain words is found in many of the documents here"
    passage = " ".join(f"item{i}" for i in range(20))
    docs = []
    for i, t, _ in texts:
        if i % 7 == 0:
            t += "\n" + shared
        if i % 11 == 0:
            t += "\n" + f"entry made by {rng.choice(['anna', 'ben', 'cleo'])} for the common list of all"
        if i % 30 == 2:
            t = passage + " " + t
        docs.append((i, t))
    docs += [(300 + k, docs[5][1].replace("w1", "v1", 1) if k else docs[5][1]) for k in range(4)]
    docs += [(None, "x y z"), (None, "x y z"), (400, None), (401, ""), (402, " ".join(f"long{i % 501} z{i % 17}" for i in range(9_000))), (5, "another text with a shared id"), (403, "the same row"), (403, "the same row")]
    return docs, [(i, int(g > 0), int(g == 1)) for i, _, g in texts], [(1, passage), (2, None)]


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_against_brute_force(spark, documents, tmp_path):
    """Each stage against the plain form of its rule, on what the stage before it kept."""
    docs, labels, bench = corpus()
    d = str(tmp_path)
    frame = documents(*docs)
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{d}/documents.parquet")

    model = train(now, graded(spark.read.parquet(f"{d}/labels.parquet")))
    want = Counter((i, t) for i, t in docs if quality.brute_score(t, model)[1] >= 0.5)
    now = corpus_pipeline.materialise(stages["quality classifier"](spark, now, d), "stage")
    assert pairs(now) == want and 0 < sum(want.values()) < len(docs)

    before = list(want.elements())
    firsts = {}
    for i, t in before:  # the rule speaks of texts; those without an id come last
        key = (1 << 62) if i is None else i
        if t is not None:
            firsts[t] = min(firsts.get(t, 1 << 62), key)
    ordered = sorted(firsts, key=firsts.get)
    cleaned = dict(zip(ordered, lines.brute(list(enumerate(ordered))).values(), strict=True))
    want = Counter((i, None if t is None else cleaned[t]) for i, t in before if t is None or cleaned[t] or not t)
    now = corpus_pipeline.materialise(stages["line dedup"](spark, now, d), "stage")
    assert pairs(now) == want and any(cleaned[t] != t for t in cleaned)
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in now.collect())

    rows = sorted(want.elements(), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = [joined.grams_of(t, 5) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    want = Counter(rows[min(g)] for g in groups.values())
    now = corpus_pipeline.materialise(stages["n-gram jaccard join"](spark, now, d), "stage")
    assert pairs(now) == want and len(groups) < len(rows)

    found = {(doc, text): bad for (doc, text), (*_, bad) in zip(sorted(want, key=str), (decontamination.brute([(0, t)], bench[:1], 13)[0] for _, t in sorted(want, key=str)), strict=True)}
    now = corpus_pipeline.materialise(stages["benchmark decontamination"](spark, now, d), "stage")
    assert pairs(now) == Counter({k: n for k, n in want.items() if not found[k]}) and any(found.values())
    assert now.columns == frame.columns

    packed = stages["best-fit packing"](spark, now, d)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in pairs(now)}


def test_empty_table(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0
