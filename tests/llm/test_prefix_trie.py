import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from lexspark.llm import prefix_trie
from lexspark.llm.prefix_trie import Turns, ends, rebuilt, trie, turns
from lexspark.llm.queries import op11_prefix_trie

@pytest.fixture(autouse=True)
def spread(spark):
    """Small partitions stay as they are, as on a cluster with much more data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ROW = "conv_id bigint, turn bigint, role string, text string, conv string, d int, key string, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k", 0) for r in rows], ROW)


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def again(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + convs[c][h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        last = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(spark, rows):
    found = turns(table(spark, rows).repartition(3))
    convs = ordered(rows)
    assert got(trie(found)) == brute(convs)
    assert got(trie(rebuilt(found))) == brute(again(convs))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(70):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "system", rng.choice(["a b", "a", "", "c\td e"])))
    check(spark, rows)


def test_deep_copies_and_a_hot_group(spark, monkeypatch):
    """Copies that agree for many turns, over several blocks; a third of all conversations are one."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    long = [(t, "user", f"turn {t}") for t in range(40)]
    rows = [(c, *x) for c in range(5) for x in long[: 40 - c]] + [(9, *x) for x in [*long[:20], (20, "user", "other"), (21, "user", "end")]]
    rows += [(c, t, "user", f"hot {t}") for c in range(100, 130) for t in range(3)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (2, 5, "user", ""), (2, None, "", ""), (None, 0, "user", "lost"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "user", "earlier"), (-7, 0, "user", "n"), (-20, 0, "user", "m"), (4, 0, "a", "b" * 100_000), (5, 0, "ab", ""), (6, 0, "a", "b")]
    check(spark, rows)


def test_few_conversations(spark):
    assert trie(turns(table(spark, [(None, 0, "user", "x")]))).count() == 0
    assert trie(turns(table(spark, [(1, 0, "u", "x")]).where("conv_id < 0"))).count() == 0
    check(spark, [(5, 0, "user", "a"), (5, 1, "user", "b")])
    check(spark, [(20, 0, "user", "a"), (21, 1, "user", "a")])


def test_conversations_without_turns(spark):
    none = turns(table(spark, [(1, 0, "user", "x")]))
    lengths = spark.createDataFrame([(3, 0), (1, 1), (12, 0)], "conv bigint, length bigint")
    assert got(trie(Turns(none.turns, lengths))) == brute({1: [("user", "x")], 3: [], 12: []})
    empty = spark.createDataFrame([(3, 0), (12, 0)], "conv bigint, length bigint")
    assert got(trie(Turns(none.turns.where("d < 0"), empty))) == brute({3: [], 12: []})


def test_a_conversation_that_holds_most_rows(spark):
    """Its turns are numbered over several tasks, and its tail is emitted from its length."""
    rows = [(1, t, "user", f"{t}") for t in range(6_000)] + [(c, 0, "user", "0") for c in range(2, 40)]
    found = turns(table(spark, rows).repartition(6))
    numbers = sorted(r["d"] for r in found.turns.where("conv = 1").select("d").collect())
    assert numbers == list(range(1, 6_001))
    made = trie(found)
    assert made.count() == 6_001 and made.where("n_convs > 1").count() == 2
    assert made.where("conv_id = 1 and depth = 6000").first()["ends_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert made.where("depth = 0").first()["n_leaves"] == 1


def test_ends_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(bytes([k % 3]) * 4, (k * 7_919) % 1_000 - 300) for k in range(1_000)]
    found = {bytes(r["cls"]): r["ends_sha256"] for r in ends(spark.createDataFrame(rows, "cls binary, conv bigint").repartition(5)).collect()}
    for k in range(3):
        own = sorted(c for b, c in rows if b == bytes([k]) * 4)
        assert found[bytes([k]) * 4] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()


def test_query(spark, small):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert got(op11_prefix_trie(spark, small)) == brute(again(ordered(rows)))
