"""Rules applied to strings and to string columns.

A rule is compiled once on the driver, broadcast, and applied to Arrow batches; equal
inputs of a batch are rewritten once. A cascade is one function: one crossing to Python,
however many rules it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fst
from .fst import Fst, accep, as_fst, best_paths, closure, compose, concat, cross, project, rmepsilon, text_of, union


class RewriteError(ValueError):
    pass


def rewrite_lattice(text: str | Fst, rule: Fst, mode=None) -> Fst:
    """The outputs of a string as an acceptor; an error if there is none."""
    found = rmepsilon(project(compose(accep(text, mode=mode) if isinstance(text, str) else text, rule), "output"))
    if found.start < 0:
        raise RewriteError(f"composition fails: {text!r}")
    return found


def lattice_to_dfa(lattice: Fst, optimal: bool = False, state_multiplier: int = 4) -> tuple[Fst, bool]:
    """Deterministic form within 256 + multiplier * states, and whether that bound cut it off."""
    if optimal:
        lattice = fst.prune(lattice, 0.0)
    most = 256 + state_multiplier * lattice.num_states()
    made = fst.determinize(lattice, most)
    return made, made.num_states() >= most


class Truncated(RewriteError):
    """The outputs are more than the deterministic form of their lattice may hold; ``found`` are those within it."""

    def __init__(self, text: str, found: list[tuple[str, float]]):
        super().__init__(f"outputs are cut off: {text!r}")
        self.found = found


def _all(text: str, lattice: Fst, mode=None) -> list[tuple[str, float]]:
    made, cut = lattice_to_dfa(lattice)
    found = [(text_of(o, mode), w) for _, o, w in best_paths(made, None, True)]
    if cut:
        raise Truncated(text, found)
    return found


def rewrites(text: str, rule: Fst, mode=None) -> list[tuple[str, float]]:
    """All distinct outputs with their least costs; ties in the order of the labels. If they are cut off, an error that holds the others."""
    return _all(text, rewrite_lattice(text, rule, mode), mode)


def top_rewrites(text: str, rule: Fst, n: int, mode=None) -> list[tuple[str, float]]:
    return [(text_of(o, mode), w) for _, o, w in best_paths(rewrite_lattice(text, rule, mode), n, True)]


def top_rewrite(text: str, rule: Fst, mode=None) -> str:
    """A best output; of several, the first in the order of the labels."""
    return top_rewrites(text, rule, 1, mode)[0][0]


def optimal_rewrites(text: str, rule: Fst, mode=None) -> list[str]:
    found, best = [], None
    for _, o, w in best_paths(rewrite_lattice(text, rule, mode), None, True):
        best = w if best is None else best
        if w > best + 1e-9:
            break
        found.append(text_of(o, mode))
    return found


def one_top_rewrite(text: str, rule: Fst, mode=None) -> str:
    found = optimal_rewrites(text, rule, mode)
    if len(found) > 1:
        raise RewriteError(f"several best outputs: {text!r}")
    return found[0]


def matches(text: str, output: str, rule: Fst, mode=None) -> bool:
    return compose(compose(accep(text, mode=mode), rule), accep(output, mode=mode)).start >= 0


def lenient(rule: Callable[[str], str | None], fallback: Callable[[str], str | None]) -> Callable[[str], str | None]:
    """Priority union at the level of strings: the fallback where the rule gives nothing."""
    return lambda text: fallback(text) if (out := rule(text)) is None else out


@dataclass
class Cascade:
    """Rules in order; each takes what the one before it gave. Names may carry parentheses and assignments: rule$parens$assignments."""

    rules: list[Fst]

    def lattice(self, text: str, mode=None) -> Fst:
        found = accep(text, mode=mode)
        for rule in self.rules:
            found = rewrite_lattice(found, rule, mode)
        return found

    def top_rewrite(self, text: str, mode=None) -> str:
        return text_of(next(best_paths(self.lattice(text, mode), 1, True))[1], mode)

    def rewrites(self, text: str, mode=None) -> list[str]:
        return [x for x, _ in _all(text, self.lattice(text, mode), mode)]


class Registry:
    """Named rules, and cascades by ``name$parens$assignments`` lists."""

    def __init__(self, rules: dict[str, Fst] | None = None):
        self.rules = dict(rules or {})

    def __getitem__(self, name: str) -> Fst:
        return self.rules[name]

    def cascade(self, *names: str) -> Cascade:
        from .pushdown import expand

        made = []
        for name in names:
            rule, *extra = name.split("$")
            f = self.rules[rule]
            if extra:
                f = expand(f, self.rules[extra[0]], self.rules[extra[1]] if len(extra) > 1 else None)
            made.append(f)
        return Cascade(made)


METHODS: dict[str, tuple[Callable, T.DataType, pa.DataType]] = {
    "top_rewrite": (top_rewrite, T.StringType(), pa.string()),
    "one_top_rewrite": (one_top_rewrite, T.StringType(), pa.string()),
    "optimal_rewrites": (optimal_rewrites, T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "rewrites": (lambda s, r: [x for x, _ in rewrites(s, r)], T.ArrayType(T.StringType()), pa.list_(pa.string())),
}


def apply(df: DataFrame, column: str, rule: Fst | Cascade, out: str = "rewritten", method: str = "top_rewrite", n: int | None = None, error: str | None = None) -> DataFrame:
    """Adds the outputs of a string column. Null, no output, an error of ``one_top_rewrite`` or outputs that are cut off: null.

    error: a column for the reason; outputs that are cut off are given then, with the reason beside them.
    """
    shared = df.sparkSession.sparkContext.broadcast(rule)
    f, kind, arrow = METHODS[method] if n is None else (lambda s, r: [x for x, _ in top_rewrites(s, r, n)], T.ArrayType(T.StringType()), pa.list_(pa.string()))
    is_cascade = isinstance(rule, Cascade)

    def one(text: str) -> tuple[object, str | None]:
        try:
            return getattr(shared.value, method)(text) if is_cascade else f(text, shared.value), None
        except Truncated as e:
            return [x for x, _ in e.found] if error else None, str(e)
        except RewriteError as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[object, str | None]] = {}
        for batch in batches:
            values = []
            for text in batch.column(column).to_pylist():
                if text is not None and text not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[text] = one(text)
                values.append((None, None) if text is None else memo[text])
            made = batch.append_column(out, pa.array([v for v, _ in values], arrow))
            yield made.append_column(error, pa.array([e for _, e in values], pa.string())) if error else made

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind), *([T.StructField(error, T.StringType())] if error else [])]))


def apply_distinct(df: DataFrame, column: str, rule: Fst | Cascade, out: str = "rewritten", method: str = "top_rewrite") -> DataFrame:
    """For columns of few distinct values: each is rewritten once, then joined back."""
    few = apply(df.select(column).where(F.col(column).isNotNull()).distinct(), column, rule, out, method)
    return df.join(few, column, "left")


def matching(df: DataFrame, column: str, rule: Fst, literal: str | None = None) -> DataFrame:
    """Rows whose string the rule accepts. literal: what every accepted string holds; filtered first, in the scan if it can."""
    if literal:
        df = df.where(F.col(column).contains(literal))
    return apply(df, column, rule, "_out").where("_out is not null").drop("_out")


# Small constructions.


def add_weight(x, w: float) -> Fst:
    return concat(accep("", w), as_fst(x))


def insert(x) -> Fst:
    return cross("", x)


def delete(x) -> Fst:
    return cross(x, "")


def join(x, separator) -> Fst:
    return concat(x, closure(concat(separator, x)))


def byte_set(chars: str) -> Fst:
    return Fst(0, (tuple((b, b, 0.0, 1) for b in sorted(set(chars.encode()))), ()), {1: 0.0})


DIGIT = byte_set("0123456789")
LOWER = byte_set("abcdefghijklmnopqrstuvwxyz")
UPPER = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALPHA = byte_set("".join(chr(c) for c in range(128) if chr(c).isalpha()))
ALNUM = byte_set("".join(chr(c) for c in range(128) if chr(c).isalnum()))
HEX = byte_set("0123456789abcdefABCDEF")
SPACE = byte_set(" \t\n\r\f\v")
PUNCT = byte_set("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
GRAPH = byte_set("".join(chr(c) for c in range(33, 127)))
BYTE = Fst(0, (tuple((b, b, 0.0, 1) for b in range(1, 256)), ()), {1: 0.0})
NOT_SPACE = Fst(0, (tuple((b, b, 0.0, 1) for b in range(1, 256) if chr(b) not in " \t\n\r\f\v"), ()), {1: 0.0})
NOT_QUOTE = Fst(0, (tuple((b, b, 0.0, 1) for b in range(1, 256) if b != 34), ()), {1: 0.0})


def byte_range(low: int, high: int) -> Fst:
    return Fst(0, (tuple((b, b, 0.0, 1) for b in range(low, high + 1)), ()), {1: 0.0})


def utf8_char() -> Fst:
    """One well-formed character, by the published byte ranges."""
    c = byte_range(0x80, 0xBF)
    return union(
        byte_range(0x01, 0x7F), concat(byte_range(0xC2, 0xDF), c), concat(byte_range(0xE0, 0xE0), byte_range(0xA0, 0xBF), c), concat(byte_range(0xE1, 0xEC), c, c), concat(byte_range(0xED, 0xED), byte_range(0x80, 0x9F), c),
        concat(byte_range(0xEE, 0xEF), c, c), concat(byte_range(0xF0, 0xF0), byte_range(0x90, 0xBF), c, c), concat(byte_range(0xF1, 0xF3), c, c, c), concat(byte_range(0xF4, 0xF4), byte_range(0x80, 0x8F), c, c),
    )


def tagger(label: str, matcher: Fst, sigma_star: Fst) -> Fst:
    """Wraps every match in <label> and </label>."""
    from .cdrewrite import cdrewrite

    return cdrewrite(concat(insert(f"<{label}>"), matcher, insert(f"</{label}>")), "", "", sigma_star)


def tagged(column: Column, label: str, pattern: str) -> Column:
    """The same for a regular expression, as one expression that Catalyst sees."""
    return F.regexp_replace(column, f"({pattern})", f"<{label}>$1</{label}>")
