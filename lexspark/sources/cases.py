"""Cases of rules as tables: read from files of records, applied in one pass, compared as sets.

A record is ``rewrite { ... }`` with the fields comment, rule (one or more, a cascade), input
and output (none: the input must have no output). Records cover several lines, which the
reader splits at their heads, so that a file of any size is read by many tasks.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Registry, RewriteError, Truncated

CASE = "comment string, rule array<string>, input string, output array<string>"
#: The names of the ways to compare.
MODES = ("exact", "one_top", "subset", "top")

FIELD = re.compile(r"""(?:^|[\s{;,])(comment|rule|input|output)\s*:\s*((?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:\s*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))*)""")
STRING = re.compile(r"""#[^\n]*|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""")


def _text(literals: str) -> str:
    """Adjacent literals are one string; escapes name bytes of its UTF-8."""
    raw = "".join(m[1] if m[1] is not None else m[2] or "" for m in STRING.finditer(literals))
    if "\\" not in raw:
        return raw
    return codecs.escape_decode(raw.encode())[0].decode("utf-8", "replace")


def _without_comments(record: str) -> str:
    return STRING.sub(lambda m: "" if m[0].startswith("#") else m[0], record)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for record in batch.column("value").to_pylist():
            fields: dict[str, list[str]] = {}
            for m in FIELD.finditer(_without_comments(record)):
                fields.setdefault(m[1], []).append(_text(m[2]))
            if fields.get("rule"):
                rows.append(((fields.get("comment") or [None])[0], fields["rule"], (fields.get("input") or [""])[-1], fields.get("output", [])))
        comment, rule, text, output = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(comment, pa.string()), pa.array(rule, pa.list_(pa.string())), pa.array(text, pa.string()), pa.array(output, pa.list_(pa.string()))], names=["comment", "rule", "input", "output"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(comment, rule, input, output): a row for each record."""
    return spark.read.option("lineSep", "\nrewrite").text(path).mapInArrow(_parse, CASE)


def held(actual: Column, output: Column, mode: str = "exact") -> Column:
    """Whether the outputs are as expected: the same set, the first one, a part of them, or the first ones in order."""
    if mode not in MODES:
        raise ValueError(f"not one of {', '.join(MODES)}: {mode}")
    got = F.coalesce(actual, F.array().cast("array<string>"))
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    found = {
        "exact": as_set(got) == as_set(output),
        "one_top": F.get(got, F.lit(0)).eqNullSafe(F.get(output, F.lit(0))),
        "subset": F.size(F.array_except(output, got)) == 0,
        "top": F.slice(got, 1, F.greatest(F.size(output), F.lit(1))) == output,
    }[mode]
    return F.when(F.size(output) == 0, F.size(got) == 0).otherwise(found)


def applied(cases: DataFrame, rules: Registry) -> DataFrame:
    """cases with actual, all outputs of each case's cascade of rules, the best first, and error, why there are none or not all. Equal cases of a task are rewritten once."""
    shared = cases.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, ...], object] = {}
        memo: dict[tuple[tuple[str, ...], str], tuple[list[str], str | None]] = {}

        def one(names: tuple[str, ...], text: str) -> tuple[list[str], str | None]:
            try:
                if names not in made:
                    made[names] = shared.value.cascade(*names)
                return made[names].rewrites(text), None
            except Truncated as e:
                return [x for x, _ in e.found], str(e)
            except RewriteError as e:
                return [], str(e)
            except KeyError as e:
                return [], f"no rule {e}"

        for batch in batches:
            found = []
            for names, text in zip(batch.column("rule").to_pylist(), batch.column("input").to_pylist(), strict=True):
                key = (tuple(names), text or "")
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = one(*key)
                found.append(memo[key])
            yield batch.append_column("actual", pa.array([x for x, _ in found], pa.list_(pa.string()))).append_column("error", pa.array([e for _, e in found], pa.string()))

    from pyspark.sql import types as T

    return cases.mapInArrow(run, T.StructType([*cases.schema.fields, T.StructField("actual", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))


def tested(cases: DataFrame, rules: Registry, mode: str = "exact") -> DataFrame:
    """cases with actual, error and held. A case that names no rule of the registry doesn't hold."""
    found = applied(cases, rules)
    return found.withColumn("held", held(F.col("actual"), F.col("output"), mode) & ~F.coalesce(F.col("error").startswith("no rule"), F.lit(False)))
