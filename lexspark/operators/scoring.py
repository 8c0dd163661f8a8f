"""Scoring with a backoff model: the longest n-gram that the model has, times the backoffs above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import EOS, padded, tokens
from ..tables import kept
from .smoothing import Model, backoffs

OOV_SIZE = 10_000


def predictions(rows: DataFrame, order: int, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys..., pos, hist, word): each word of each text and its end mark, with up to order - 1 words before."""
    seq = padded(tokens(F.col(text)))
    made = rows.select(*(keys or []), F.posexplode(F.array(seq)).alias("_k", "seq"))
    at = F.sequence(F.lit(2), F.size("seq"))

    def row(i: Column) -> Column:
        start = F.greatest(F.lit(1), i - order + 1)
        return F.struct(i.alias("pos"), F.array_join(F.slice("seq", start, i - start), " ").alias("hist"), F.element_at("seq", i).alias("word"))

    return made.select(*(keys or []), F.explode(F.transform(at, row)).alias("x")).select(*(keys or []), "x.pos", "x.hist", "x.word")


def _cut(hist: Column, n: int) -> Column:
    """The last n words of a history."""
    return F.substring_index(hist, " ", -n) if n else F.lit("")


def with_unknown(model: Model, oov: float) -> Model:
    """Unigrams less the mass of unknown words, and backoffs anew, so that the model stays normalised."""
    scaled = model.grams.withColumn("p", F.when(F.col("ord") == 1, F.col("p") * (1 - oov)).otherwise(F.col("p")))
    return Model(scaled, backoffs(scaled, model.order), model.order)


def score(events: DataFrame, model: Model, oov: float = 0.0, oov_size: int = OOV_SIZE, oov_symbol: str | None = None) -> DataFrame:
    """events (..., hist, word) with p, used (the order that was found, 0 for an unknown word) and oov.

    One left join for each order on (history, word) and one for each backoff. With ``oov``
    an unknown word has that mass over ``oov_size`` below its history's backoffs, and known
    unigrams the rest. ``oov_symbol``: a word of the model that stands for ``oov_size``
    unknown ones; it and each of them have its probability over that number.
    """
    if not 0 <= oov < 1:
        raise ValueError("the probability of unknown words must be at least 0 and less than 1")
    if oov and oov_symbol:
        raise ValueError("a named symbol has its own probability")
    if oov:
        model = with_unknown(model, oov)
    order = model.order
    alphas = kept(model.backoffs, "backoffs") if order > 2 else model.backoffs
    out = events.withColumn("_len", F.when(F.col("hist") == "", 0).otherwise(F.size(F.split("hist", " "))))
    for n in range(1, order + 1):
        table = model.grams.where(F.col("ord") == n).select(F.col("hist").alias(f"_h{n}"), F.col("word").alias(f"_w{n}"), F.col("p").alias(f"_p{n}"))
        out = out.join(table, (F.when(F.col("_len") >= n - 1, _cut(F.col("hist"), n - 1)) == F.col(f"_h{n}")) & (F.col("word") == F.col(f"_w{n}")), "left").drop(f"_h{n}", f"_w{n}")
        if n > 1:
            table = alphas.select(F.col("hist").alias(f"_h{n}"), F.col("alpha").alias(f"_a{n}"))
            out = out.join(table, F.when(F.col("_len") >= n - 1, _cut(F.col("hist"), n - 1)) == F.col(f"_h{n}"), "left").drop(f"_h{n}")
    unit = F.lit(oov / oov_size) if oov else F.lit(None).cast("double")
    named = F.lit(False)
    if oov_symbol:
        share = model.grams.where((F.col("ord") == 1) & (F.col("word") == oov_symbol)).agg(F.max("p").alias("_named"))  # one row
        out = out.crossJoin(F.broadcast(share))
        unit, named = F.col("_named") / oov_size, F.col("word") == oov_symbol
    unknown = F.col("_p1").isNull()
    p = F.coalesce("_p1", unit)
    used = F.when(unknown, 0).otherwise(1)
    for n in range(2, order + 1):
        p = F.coalesce(F.col(f"_p{n}"), F.coalesce(F.col(f"_a{n}"), F.lit(1.0)) * p)
        used = F.when(F.col(f"_p{n}").isNotNull(), n).otherwise(used)
    drop = ["_len", *(f"_p{n}" for n in range(1, order + 1)), *(f"_a{n}" for n in range(2, order + 1)), *(["_named"] if oov_symbol else [])]
    return out.withColumn("p", F.when(named, p / oov_size).otherwise(p)).withColumn("used", used).withColumn("oov", unknown | named).drop(*drop)


def reset_after_unknown(events: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """Histories that begin after the last unknown word before each event: unknown words leave no context."""
    known = model.grams.where("ord = 1").select("word").withColumn("_known", F.lit(True))
    flagged = events.join(known, "word", "left")
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.when(F.col("_known").isNull(), F.col("pos"))).over(before), F.lit(0))
    n = F.col("pos") - last - 1
    cut = F.when(last == 0, F.col("hist")).when(n <= 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("hist", " "), F.greatest(F.size(F.split("hist", " ")) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), " "))
    return flagged.withColumn("hist", cut).drop("_known")


def perplexity(rows: DataFrame, model: Model, text: str = "text", by: list[str] | None = None, oov: float = 0.0, id_col: str = "doc_id", oov_size: int = OOV_SIZE, oov_symbol: str | None = None, inside: Column | None = None) -> DataFrame:
    """(by..., sentences, words, oovs, skipped, logprob10, perplexity).

    inside: a condition on the column hist; the logarithms of words whose history is outside
    are left off, while all words count.
    """
    keys = [*(by or []), id_col]
    events = reset_after_unknown(predictions(rows, model.order, text, keys), model, keys)
    scored = score(events, model, oov, oov_size, oov_symbol)
    summed = F.log10("p") if inside is None else F.when(inside, F.log10("p"))
    end = F.col("word") == EOS
    sums = scored.groupBy(*(by or [])).agg(
        F.sum(F.when(end, 1).otherwise(0)).alias("sentences"),
        F.sum(F.when(end, 0).otherwise(1)).alias("words"),
        F.sum(F.when(F.col("oov"), 1).otherwise(0)).alias("oovs"),
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("skipped"),
        F.coalesce(F.sum(summed), F.lit(0.0)).alias("logprob10"),
    )
    n = F.col("words") - F.col("skipped") + F.col("sentences")
    return sums.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("logprob10") / n))


def history_probability(model: Model, stationary: bool = False, rounds: int = 10_000) -> DataFrame:
    """(hist, ph): the chance of a history, the product of its words' probabilities in ascending order; p(<s>) = p(</s>).

    stationary: in place of that, how often the history is met in texts that follow one another, after ``rounds``
    rounds at most.
    """
    if stationary:
        from .chains import stationary_histories

        return stationary_histories(model, rounds=rounds)
    one = model.grams.where("ord = 1").select(F.when(F.col("word") == EOS, "<s>").otherwise(F.col("word")).alias("hist"), F.col("p").alias("ph"))
    out, last = one, one
    for n in range(2, model.order):
        own = model.grams.where(F.col("ord") == n)
        last = own.join(last.withColumnRenamed("ph", "q"), "hist").select(F.concat_ws(" ", "hist", "word").alias("hist"), (F.col("q") * F.col("p")).alias("ph"))
        out = out.unionByName(last)
    total = model.grams.sparkSession.createDataFrame([("", 1.0)], "hist string, ph double")
    return total.unionByName(out)


def info(model: Model) -> DataFrame:
    """(key, value): n-grams by order, states, arcs, backoff arcs and final states."""
    g = model.grams
    rows = [g.groupBy("ord").agg(F.count("*").alias("value")).select(F.concat(F.lit("ngrams_"), F.col("ord")).alias("key"), "value")]
    states = g.where("ord > 1").select("hist").distinct().where("hist != ''")
    rows.append(states.agg((F.count("*") + 1).alias("value")).select(F.lit("states").alias("key"), "value"))
    rows.append(g.agg(F.sum(F.when(F.col("word") != EOS, 1).otherwise(0)).alias("value")).select(F.lit("arcs").alias("key"), "value"))
    rows.append(states.agg(F.count("*").alias("value")).select(F.lit("backoff_arcs").alias("key"), "value"))
    rows.append(g.agg(F.sum(F.when(F.col("word") == EOS, 1).otherwise(0)).alias("value")).select(F.lit("final_states").alias("key"), "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


