import random
from collections import defaultdict

import pytest
from lexspark.llm.line_templates import cleaned, generalised, parsed, worth


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_recurring_lines_go_but_for_the_first(documents):
    passage = " ".join(f"w{chr(97 + i % 26)}x" for i in range(60))
    rng = random.Random(1)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    mine = {i: own() for i in range(12)}
    docs = [(i, f"{mine[i]}\n{passage}" if i in (2, 5, 7, 9) else mine[i]) for i in range(12)]
    got = text_of(cleaned(documents(*docs)))
    assert got == {i: f"{mine[i]}\n{passage}" if i == 2 else mine[i] for i in range(12)}
    counts = {r["doc_id"]: (r["__lx_lines"], r["__lx_dropped"]) for r in cleaned(documents(*docs)).collect()}
    assert counts[2] == (2, 0) and counts[5] == (2, 1) and counts[0] == (1, 0)


def test_variable_fields(documents):
    line = "session opened for user {} who logged in from host {} at the gate"
    docs = [(i, f"body number{'abcde'[i]} of this one\n" + line.format(["anna", "ben", "cleo", "dora", "emil"][i], 10 + i)) for i in range(5)]
    got = text_of(cleaned(documents(*docs)))
    assert got[0] == docs[0][1] and all("logged" not in got[i] for i in range(1, 5))


def test_whole_copies_count_once(documents):
    docs = [(i, "this exact text is a copy") for i in range(9)] + [(10, "this other text stays too")]
    assert text_of(cleaned(documents(*docs))) == dict(docs)


def brute(docs, lead=4, alike=0.7, least=3, shortest=3, long=40):
    """The rules of the docstring in plain words: no hashes, no joins."""
    texts = {}
    for i, t in docs:
        if t is not None:
            texts[t] = min(texts.get(t, 1 << 63), i)
    plain = lambda x: tuple("<*>" if any(c in "0123456789" for c in t) else t for t in x.split(" ") if t)
    fine = lambda w: len(w) >= shortest and 2 * w.count("<*>") <= len(w)
    wording = {w: w for t in texts for x in t.split("\n") if fine(w := plain(x))}
    own = {w: w.count("<*>") for w in wording}
    play = dict(wording)
    while True:
        places, others, least_own = defaultdict(set), defaultdict(set), {}
        for w, now in play.items():
            least_own[now] = min(least_own.get(now, 1 << 30), own[w])
            for p in range(lead, len(now)):
                places[len(now), w[:lead], p, now[p]].add(now)
                if now[p] != "<*>":
                    others[len(now), w[:lead], p, now[:p], now[p + 1 :]].add(now)
        wider, out = {}, set()
        for w, now in play.items():
            free = [p for p in range(lead, len(now)) if now[p] != "<*>"]
            once = [p for p in free if len(places[len(now), w[:lead], p, now[p]]) == 1]
            met = {p: n for p in free if (n := len(others[len(now), w[:lead], p, now[:p], now[p + 1 :]])) > 1}
            best = [max(met, key=lambda p: (met[p], -p))] if met else []
            fit = lambda x: x and now.count("<*>") + len(x) - least_own[now] <= (1 - alike) * len(now) + 1e-9 and 2 * (now.count("<*>") + len(x)) <= len(now)
            lone = next((x for x in (sorted({*once, *met}), once, best) if fit(x)), None)
            if lone:
                wider[now] = tuple("<*>" if p in lone else t for p, t in enumerate(now))
            elif once or met:
                out.add(now)
        if not wider and not out:
            break
        play = {w: wider.get(now, now) for w, now in play.items() if now not in out}
        wording |= play
    holders = defaultdict(set)
    for t in texts:
        for x in t.split("\n"):
            if fine(plain(x)):
                holders[wording[plain(x)]].add(t)
            if len(" ".join(x.split())) >= long:
                holders["= " + " ".join(x.split())].add(t)
    gone = lambda k, t, n: len(holders[k]) >= n and min(holders[k], key=texts.get) != t
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        kept = [x for x in t.split("\n") if not (fine(plain(x)) and gone(wording[plain(x)], t, least) or len(" ".join(x.split())) >= long and gone("= " + " ".join(x.split()), t, 2))]
        out[i] = "\n".join(kept)
    return out


NAMES = ["".join(c) for c in zip("abcdefghijklmnopqrst", "elaroinusmelaroinusm", strict=True)]


@pytest.mark.parametrize("grid", ["one field", "whole grid", "part of a grid", "every value twice"])
def test_fields_whose_values_repeat(documents, grid):
    """A boilerplate line with two fields, each line in a text of its own: all but the first go."""
    rng = random.Random(5)
    pairs = {
        "one field": [(x, "rome") for x in NAMES],
        "whole grid": [(x, y + "ville") for x in NAMES for y in NAMES],
        "part of a grid": rng.sample([(x, y + "ville") for x in NAMES for y in NAMES], 60),
        "every value twice": [(NAMES[k % 10], NAMES[(k + (k >= 10)) % 10] + "ville") for k in range(20)],
    }[grid]
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9))
    docs = [(i, f"{own()}\nWritten by our editor {x} for readers in {y} every day") for i, (x, y) in enumerate(pairs)]
    got = cleaned(documents(*docs)).collect()
    assert sum(r["__lx_dropped"] for r in got) == len(docs) - 1
    assert {r["doc_id"] for r in got if not r["__lx_dropped"]} == {0}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(documents, seed):
    rng = random.Random(seed)
    forms = [[rng.choice("abcd") + rng.choice("xyz") for _ in range(rng.choice((5, 8, 12)))] for _ in range(6)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(forms))
            for p in rng.sample(range(len(w)), rng.choice((0, 1, 2))):
                w[p] = rng.choice(("anna", "ben", "q7", f"v{chr(97 + rng.randint(0, 25))}"))
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(98, docs[3][1]), (99, None)]
    assert text_of(cleaned(documents(*docs))) == brute(docs)


@pytest.mark.parametrize("templates", [9, 200])
def test_templates_of_one_leaf_that_interleave(spark, templates):
    """All share their token count and leading tokens, and vary at the next token."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40 * templates)]
    rows = [(f"{t}-{k}".encode(), 7, f"a b c d {names[40 * t + k]} " + " ".join(f"t{chr(97 + t % 26)}{chr(97 + t // 26)}{p}" for p in "pqrs"), t) for t in range(templates) for k in range(40)]
    lines = spark.createDataFrame(rows, "line binary, leaf bigint, words string, t int")
    found = defaultdict(set)
    for r in generalised(lines.drop("t"), 4, 0.7).join(lines.select("line", "t"), "line").collect():
        found[bytes(r["template"])].add(r["t"])
    assert len(found) == templates and all(len(x) == 1 for x in found.values())


def test_worth():
    assert not worth(parsed(b"1 2 3 a"), 3) and worth(parsed(b"1 b c a"), 3) and not worth([b"a", b"b"], 3)


def test_odd_rows(odd, empty):
    got = cleaned(odd)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "__lx_lines", "__lx_dropped"]
    assert {r["text"] for r in got.where("doc_id = 1").collect()} == {None}
    assert got.where("__lx_dropped > 0").count() == 0
    assert cleaned(empty).count() == 0


def test_long_lines_go_from_the_second_text_on(documents):
    """In two texts only; also mostly digits, or without blanks. Lines that differ in a digit, and short ones, stay."""
    same = ["a passage of plain words that two different texts hold alike", "10.1 20.2 30.3 40.4 50.5 60.6 70.7 80.8 90.9 11.1", "今日は天気がとても良いので公園へ散歩に行きましたそして友達に会って一緒に昼ご飯を食べました", "x" * 40]
    other = ["short one", "日本語の行", "1.1 20.2 30.3 40.4 50.5 60.6 70.7 80.8 90.9 11.{}"]
    docs = [(i, "\n".join([f"own {'abc'[i]}", *same, *(x.format(i) for x in other)])) for i in (2, 1)]
    got = text_of(cleaned(documents(*docs)))
    assert got == {1: docs[1][1], 2: "\n".join(["own c", *(x.format(2) for x in other)])}
