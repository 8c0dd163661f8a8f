"""N-gram counting.

Counts are rows (ord, hist, word, c): hist holds the words before the last one, joined by
spaces (empty for unigrams). A sentence is counted with one begin and one end mark; the
begin mark is no unigram of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import EOS, padded, tokens
from .chunks import counter

GRAM = ["ord", "hist", "word"]


def _of_order(seq: Column, n: int) -> Column:
    start = 2 if n == 1 else 1
    last = F.size(seq) - n + 1
    at = F.when(last >= start, F.sequence(F.lit(start), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("ord"), F.array_join(F.slice(seq, i, F.lit(n - 1)), " ").alias("hist"), F.element_at(seq, i + n - 1).alias("word")))


def grams(seq: Column, order: int, only: list[int] | None = None) -> Column:
    """All n-grams up to an order of a padded sequence, or those of some orders, as structs."""
    return F.concat(*(_of_order(seq, n) for n in only or range(1, order + 1)))


def count(rows: DataFrame, order: int = 3, text: str = "text", by: list[str] | None = None, weight: Column | None = None, only: list[int] | None = None) -> DataFrame:
    """(by..., ord, hist, word, c). A weight of a row counts for each of its n-grams. only: the orders to count, in place of all."""
    keys, orders = by or [], sorted(only or range(1, order + 1))
    if not keys and weight is None:
        # Sums within chunks come before the shuffle, and nothing is gained by doing that again.
        each = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(counter(orders), "ord int, hist string, word string, c bigint")
        return each.repartition(*GRAM).groupBy(*GRAM).agg(F.sum("c").alias("c"))
    made = rows.select(*keys, padded(tokens(F.col(text))).alias("seq"), *([weight.alias("_w")] if weight is not None else []))
    total = F.count("*") if weight is None else F.sum("_w")
    return _each(made, orders).groupBy(*keys, *GRAM).agg(total.alias("c"))


def _each(rows: DataFrame, orders: list[int]) -> DataFrame:
    """A row for each n-gram of the padded sequence in column seq, with the other columns; no array of n-grams is made."""
    made = rows.select("*", F.posexplode("seq").alias("_i", "word")).select("*", F.explode(F.array(*map(F.lit, orders))).alias("ord")).where("_i >= greatest(ord - 1, 1)")
    hist = F.lit(None).cast("string")
    for n in orders:
        hist = F.when(F.col("ord") == n, F.concat_ws(" ", *(F.get("seq", F.col("_i") - k) for k in range(n - 1, 0, -1))) if n > 1 else F.lit("")).otherwise(hist)
    return made.select(*(c for c in rows.columns if c != "seq"), "ord", hist.alias("hist"), "word")


def ngram(hist: str | Column = "hist", word: str | Column = "word") -> Column:
    """The n-gram as one string."""
    h, w = (F.col(x) if isinstance(x, str) else x for x in (hist, word))
    return F.when(h == "", w).otherwise(F.concat(h, F.lit(" "), w))


def suffix(hist: str | Column = "hist") -> Column:
    """The history without its first word."""
    h = F.col(hist) if isinstance(hist, str) else hist
    return F.when(F.instr(h, " ") > 0, F.expr(f"substring({hist}, instr({hist}, ' ') + 1)") if isinstance(hist, str) else F.regexp_replace(h, "^[^ ]* ", "")).otherwise(F.lit(""))


def head(gram: Column) -> Column:
    """All but the last word of an n-gram string."""
    return F.when(F.instr(gram, " ") > 0, F.regexp_replace(gram, " [^ ]*$", "")).otherwise(F.lit(""))


def tail(gram: Column) -> Column:
    return F.substring_index(gram, " ", -1)


def history_totals(counts: DataFrame) -> DataFrame:
    """(ord, hist, total, types): sum and number of continuations, the end mark with them."""
    return counts.groupBy("ord", "hist").agg(F.sum("c").alias("total"), F.count("*").alias("types"))


def rounded(counts: DataFrame) -> DataFrame:
    """Merged counts as integers, half up."""
    return counts.withColumn("c", F.floor(F.col("c") + 0.5).cast("bigint")).where("c > 0")


def add_to_unigrams(counts: DataFrame, symbols: DataFrame, k: float) -> DataFrame:
    """Adds k to the unigram of every symbol of the table; label 0 stands for the end mark."""
    rows = symbols.select(F.lit(1).alias("ord"), F.lit("").alias("hist"), F.when(F.col("label") == 0, F.lit(EOS)).otherwise(F.col("symbol")).alias("word"), F.lit(float(k)).alias("c"))
    return counts.withColumn("c", F.col("c").cast("double")).unionByName(rows).groupBy(*GRAM).agg(F.sum("c").alias("c"))


def reversed_context(counts: DataFrame) -> DataFrame:
    """(ngram, c) with the history's words last one first."""
    back = F.array_join(F.reverse(F.split("hist", " ")), " ")
    return counts.select("ord", F.when(F.col("hist") == "", F.col("word")).otherwise(F.concat(back, F.lit(" "), F.col("word"))).alias("ngram"), "c")


def count_of_counts(counts: DataFrame, bins: int = 32, inside: Column | None = None) -> DataFrame:
    """(ord, r, n): how many n-grams of an order occur r times, r up to bins + 1. inside: only those whose history meets a condition on hist."""
    if not 0 < bins <= 32:
        raise ValueError("bins must be from 1 to 32")
    r = F.floor(F.col("c") + 0.5).cast("bigint")
    counts = counts if inside is None else counts.where(inside)
    return counts.select("ord", r.alias("r")).where((F.col("r") >= 1) & (F.col("r") <= bins + 1)).groupBy("ord", "r").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, order: int = 3, text: str = "text", most: int = 5, weight: Column | None = None) -> DataFrame:
    """(ord, hist, word, expected, p): p[k] is the chance that the n-gram occurs k times in all rows, k up to ``most``.

    A row is there with the probability ``weight`` (always, if none is given), independently
    of the others, and has then the n-gram as often as it is counted in it: the distributions
    of all rows are convolved. Rows with the same count and weight are one factor whose power
    has a closed form, so that what is folded for an n-gram is a few numbers whatever its
    count. Mass of more than ``most`` is left off.
    """
    seq = padded(tokens(F.col(text)))
    one = rows.select(F.monotonically_increasing_id().alias("_id"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"), seq.alias("seq"))
    each = _each(one, list(range(1, order + 1))).groupBy("_id", *GRAM).agg(F.first("_w").alias("w"), F.count("*").alias("c"))
    # Rows that hold the n-gram more than ``most`` times are alike: none of it is left if one is there.
    alike = each.groupBy(*GRAM, F.least("c", F.lit(most + 1)).alias("c"), "w").agg(F.count("*").alias("m"), F.sum(F.col("w") * F.col("c")).alias("e"))
    # Plain arithmetic, written out: in lambdas each element would work the arrays before it out anew.
    power = lambda base, n: F.when(n == 0, 1.0).otherwise(F.pow(base, n))
    ways, chance = F.lit(1.0), []
    for i in range(most + 1):
        ways = ways * (F.col("m") - i + 1) / i if i else ways
        chance.append(F.when(F.col("m") < i, 0.0).otherwise(ways * power(F.col("w"), F.lit(i)) * power(1 - F.col("w"), F.col("m") - i)))
    alike = alike.select("*", *(x.alias(f"_{i}") for i, x in enumerate(chance)))
    each_count = [F.col("_0")]
    for k in range(1, most + 1):
        found = F.lit(0.0)
        for c in range(1, k + 1):
            found = found if k % c else F.when(F.col("c") == c, F.col(f"_{k // c}")).otherwise(found)
        each_count.append(found)
    factor = F.array(*each_count)
    folded = alike.groupBy(*GRAM).agg(F.sum("e").alias("expected"), F.collect_list(F.struct("c", "w", factor.alias("f"))).alias("all"))
    start = F.array(F.lit(1.0), *(F.lit(0.0) for _ in range(most)))
    return folded.select(*GRAM, "expected", F.aggregate(F.transform(F.sort_array("all"), lambda x: x["f"]), start, lambda a, f: convolved(a, f, most + 1)).alias("p"))


def count_of_histograms(histograms: DataFrame, bins: int = 32) -> DataFrame:
    """(ord, r, n): the expected number of n-grams of an order that occur r times, r up to the length of p."""
    rows = histograms.select("ord", F.posexplode("p").alias("r", "q")).where((F.col("r") >= 1) & (F.col("r") <= bins + 1) & (F.col("q") > 0))
    return rows.groupBy("ord", F.col("r").cast("bigint").alias("r")).agg(F.sum("q").alias("n"))


def convolved(a: Column, b: Column, bins: int = 6) -> Column:
    """Distribution of the sum of two independent counts, from the distributions of 0, 1, ..."""
    return F.array(*(reduce(lambda s, i: s + F.element_at(a, i + 1) * F.element_at(b, k - i + 1), range(k + 1), F.lit(0.0)) for k in range(bins)))  # noqa: B023


def sorted_states(counts: DataFrame) -> DataFrame:
    """In the order of the history, then the word."""
    return counts.orderBy("hist", "word")
