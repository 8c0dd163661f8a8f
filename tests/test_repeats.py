"""Work that repeats in the input is done once."""

import math
from types import SimpleNamespace

import pyarrow as pa
from lexspark.operators import em
from lexspark.sources import cases


def test_equal_pairs_are_aligned_once(spark, monkeypatch):
    pairs = spark.createDataFrame([(["a", "b"], ["x"])] * 5 + [(["a"], ["y", "x"])] * 3 + [(["q"], ["x"])], "x array<string>, y array<string>")
    start = em.initial(spark, list("ab"), list("xy"))
    p = em._collected(start)
    each, seen = em.e_step, []

    def counted(part, model, **options):
        seen.append(part.count())
        return each(part, model, **options)

    monkeypatch.setattr(em, "e_step", counted)
    model, history = em.train(pairs, start, 1)
    assert seen == [3]
    want, like = {}, 0.0
    for x, y, n in ((["a", "b"], ["x"], 5), (["a"], ["y", "x"], 3)):
        counts, ll = em.expectations(x, y, p)
        like += n * ll
        for e, c in counts.items():
            want[e] = want.get(e, 0.0) + n * c
    sums = {a: sum(c for (b, _), c in want.items() if b == a) for a, _ in want}
    found = {(r["ilabel"], r["olabel"]): r["p"] for r in model.collect()}
    assert math.isclose(history[0], like, rel_tol=1e-12)
    assert found.keys() == want.keys() and all(math.isclose(found[e], c / sums[e[0]], rel_tol=1e-12) for e, c in want.items())


def test_equal_cases_are_rewritten_once():
    asked = []

    class Rules:
        def cascade(self, *names):
            return SimpleNamespace(rewrites=lambda text: asked.append((names, text)) or [text.upper()])

    batch = pa.record_batch([pa.array([["A"]] * 7 + [["B"]]), pa.array(["a", "b", None, "a", "b", "a", "", "a"])], names=["rule", "input"])
    local = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=local), schema=SimpleNamespace(fields=[]), mapInArrow=lambda run, kind: list(run([batch, batch])))
    found = cases.applied(frame, Rules())
    assert asked == [(("A",), "a"), (("A",), "b"), (("A",), ""), (("B",), "a")]
    assert [x.column("actual").to_pylist() for x in found] == [[["A"], ["B"], [""], ["A"], ["B"], ["A"], [""], ["A"]]] * 2
