"""Queries over the test tables, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.tokens import vocabulary
from .operators import counting, merging, scoring, shrinking, smoothing
from .sources import arpa
from .tables import discard, kept, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _dealt(df: DataFrame) -> DataFrame:
    """The scan as it is; dealt to a number of partitions if the session asks for it by ``spark.lexspark.inputPartitions``."""
    n = df.sparkSession.conf.get("spark.lexspark.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def docs(spark: SparkSession, sf_dir: str, name: str = "documents", *columns: str) -> DataFrame:
    return _dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or ("text",))))


def counted(order: int, source: str = "documents", where: str = "TRUE", name: str = "", keep: str = "") -> str:
    """CTEs toks, sent, grams and c (ord, hist, word, low, c), with a suffix to their names."""
    more = f", {keep}" if keep else ""
    return f"""toks{name} AS (SELECT list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t{more} FROM {source} WHERE {where}),
sent{name} AS (SELECT list_concat(['<s>'], t, ['</s>']) AS t{more} FROM toks{name}),
grams{name} AS (SELECT o::INTEGER AS ord, array_to_string(t[i:i+o-2], ' ') AS hist, t[i+o-1] AS word, array_to_string(t[i+1:i+o-2], ' ') AS low{more}
  FROM (SELECT *, unnest(range(CASE WHEN o = 1 THEN 2 ELSE 1 END, len(t) - o + 2)) AS i FROM sent{name}, (SELECT unnest(range(1, {order + 1})) AS o))),
c{name} AS (SELECT ord, hist, word, low{more}, count(*)::BIGINT AS c FROM grams{name} GROUP BY ALL)"""


def written(ctes: str) -> str:
    """The same CTEs, each worked out once."""
    return re.sub(r"(^|\n|, )(\w+) AS \(", r"\1\2 AS MATERIALIZED (", ctes)


#: Witten-Bell of order 2 from c: u (unigrams), m (bigrams), a (backoffs).
def wb(name: str = "") -> str:
    return f"""u{name} AS (SELECT word, c / sum(c) OVER () AS p FROM c{name} WHERE ord = 1),
h{name} AS (SELECT hist, sum(c) AS n, count(*) AS k FROM c{name} WHERE ord = 2 GROUP BY hist),
m{name} AS (SELECT hist, word, c.c / (n + k) + k / (n + k) * u.p AS p, u.p AS q FROM c{name} c JOIN h{name} USING (hist) JOIN u{name} u USING (word) WHERE ord = 2),
a{name} AS (SELECT hist, CASE WHEN count(*) >= (SELECT count(*) FROM u{name}) OR 1 - sum(q) <= 0 OR 1 - sum(p) <= 0 THEN exp(-99) ELSE (1 - sum(p)) / (1 - sum(q)) END AS alpha, sum(p) AS own, sum(q) AS below FROM m{name} GROUP BY hist)"""


def absolute(name: str = "", source: str = "c") -> str:
    """Absolute discounting of order 2, interpolated, one bin."""
    return f"""nn{name} AS (SELECT count(*) FILTER (floor(c + 0.5) = 1) AS n1, count(*) FILTER (floor(c + 0.5) = 2) AS n2 FROM {source} WHERE ord = 2),
dd{name} AS (SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN 1 - 2 * (n1 / (n1 + 2 * n2)) * n2 / n1 ELSE 0.6 END AS d FROM nn{name}),
ua{name} AS (SELECT word, c / sum(c) OVER () AS p FROM {source} WHERE ord = 1),
ha{name} AS (SELECT hist, sum(c) AS n, sum(greatest(c - d, 0)) AS hh FROM {source}, dd{name} WHERE ord = 2 GROUP BY hist),
ma{name} AS (SELECT hist, word, greatest(c - d, 0) / n + (n - hh) / n * u.p AS p FROM {source} c JOIN ha{name} USING (hist) JOIN ua{name} u USING (word), dd{name} WHERE ord = 2)"""


for _n in (1, 2, 3):

    def _count(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return counting.count(docs(spark, d), n, only=[n])

    query(f"ngram_count_o{_n}", f"WITH {counted(_n)} SELECT ord, hist, word, c FROM c WHERE ord = {_n}")(_count)


def counts(spark: SparkSession, d: str, order: int = 2, source: str = "documents", where: str = "true") -> DataFrame:
    rows = docs(spark, d, source, "text", *(["lang"] if source == "documents" else ["role"] if source == "conversations" else []))
    return kept(counting.count(rows.where(where), order), "counts")


def trained(spark: SparkSession, d: str, order: int = 2, make: Callable[..., smoothing.Model] = smoothing.witten_bell, where: str = "true", **options) -> smoothing.Model:
    """A model of the documents; its counts are deleted once it is made."""
    rows, path = stored(counting.count(docs(spark, d, "documents", "text", "lang").where(where), order), "counts")
    model = make(rows, order, **options, **({"spent": path} if make in (smoothing.kneser_ney, smoothing.modified_kneser_ney) else {}))
    discard(spark, path)
    return model


@query("ngram_count_by_lang", f"WITH {counted(2, keep='lang')} SELECT lang, ord, hist, word, c FROM c WHERE ord = 2")
def ngram_count_by_lang(spark, d):
    return counting.count(docs(spark, d, "documents", "text", "lang"), 2, by=["lang"], only=[2])


@query("weighted_counts", f"WITH {counted(2, keep='quality', source='(SELECT text, quality FROM documents JOIN labels USING (doc_id))')} SELECT ord, hist, word, sum(c * (quality + 0.5))::DOUBLE AS c FROM c GROUP BY ALL")
def weighted_counts(spark, d):
    rows = docs(spark, d, "documents", "doc_id", "text").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return counting.count(rows, 2, weight=F.col("quality") + 0.5)


@query("history_totals", f"WITH {counted(2)} SELECT ord, hist, sum(c)::BIGINT AS total, count(*)::BIGINT AS types FROM c GROUP BY ALL")
def history_totals(spark, d):
    return counting.history_totals(counting.count(docs(spark, d), 2))


@query("count_of_counts", f"WITH {counted(3)} SELECT ord, c AS r, count(*)::BIGINT AS n FROM c WHERE c <= 33 GROUP BY ALL")
def count_of_counts(spark, d):
    return counting.count_of_counts(counting.count(docs(spark, d), 3))


@query("reversed_context", f"WITH {counted(3)} SELECT ord, CASE WHEN hist = '' THEN word ELSE array_to_string(list_reverse(string_split(hist, ' ')), ' ') || ' ' || word END AS ngram, c FROM c")
def reversed_context(spark, d):
    return counting.reversed_context(counting.count(docs(spark, d), 3))


@query("vocab", f"WITH {counted(1)}, w AS (SELECT DISTINCT word FROM c WHERE word <> '</s>') SELECT word AS symbol, row_number() OVER (ORDER BY encode(word))::BIGINT AS label FROM w UNION ALL SELECT '<epsilon>', 0 UNION ALL SELECT '<UNK>', count(*) + 1 FROM w")
def vocab(spark, d):
    return vocabulary(docs(spark, d))


@query("count_merge", f"WITH {counted(2, where=chr(108) + 'ang = ' + repr('en'), name='1')}, {counted(2, where='lang = ' + repr('de'), name='2')} SELECT ord, hist, word, sum(c)::DOUBLE AS c FROM (SELECT ord, hist, word, c * 1.0 AS c FROM c1 UNION ALL SELECT ord, hist, word, c * 0.5 FROM c2) GROUP BY ALL")
def count_merge(spark, d):
    return merging.merge_counts(counts(spark, d, 2, where="lang = 'en'"), counts(spark, d, 2, where="lang = 'de'"), 1.0, 0.5)


@query("context_split", f"WITH {counted(2)} SELECT ord, hist, word, c, (CASE WHEN hist = '' THEN 0 WHEN encode(hist) >= encode('o') THEN 2 WHEN encode(hist) >= encode('e') THEN 1 ELSE 0 END)::INTEGER AS context FROM c")
def context_split(spark, d):
    return merging.split(counting.count(docs(spark, d), 2), [["e"], ["o"]])


@query("count_prune", f"WITH {counted(3)}, k3 AS (SELECT * FROM c WHERE ord = 3 AND c >= 3), need AS (SELECT low AS hist, word FROM k3 UNION SELECT string_split(hist, ' ')[1], string_split(hist, ' ')[2] FROM k3), k2 AS (SELECT * FROM c WHERE ord = 2 AND (c >= 2 OR EXISTS (SELECT 1 FROM need n WHERE n.hist = c.hist AND n.word = c.word))) SELECT ord, hist, word, c FROM k3 UNION ALL SELECT ord, hist, word, c FROM k2 UNION ALL SELECT ord, hist, word, c FROM c WHERE ord = 1")
def count_prune(spark, d):
    return shrinking.count_prune(counts(spark, d, 3), "2:2;3+:3", 3)


@query("list_prune", f"WITH {counted(2)} SELECT ord, hist, word, c FROM c WHERE ord = 1 OR NOT (hist = 'the' OR word = 'the' OR (hist = 'of' AND word = 'a'))")
def list_prune(spark, d):
    listed = spark.createDataFrame([("the",), ("of a",)], "ngram string")
    return shrinking.list_prune(counting.count(docs(spark, d), 2), listed, 2)


@query("suffix_complete", f"WITH {counted(3)}, k AS (SELECT * FROM c WHERE ord = 3 AND c >= 2) SELECT DISTINCT ord, hist, word FROM k UNION SELECT 2, low, word FROM k UNION SELECT 1, '', word FROM k")
def suffix_complete(spark, d):
    return shrinking.complete(counting.count(docs(spark, d), 3, only=[3]).where("c >= 2"), 3)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("wb_bigram", f"WITH {counted(2)}, {wb()} SELECT 2 AS ord, hist, word, round(p, 9) AS p FROM m")
def wb_bigram(spark, d):
    return rounded(trained(spark, d).grams.where("ord = 2"), "p")


@query("unsmoothed_bigram", f"WITH {counted(2)} SELECT ord, hist, word, round(c / sum(c) OVER (PARTITION BY ord, hist), 9) AS p FROM c")
def unsmoothed_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.unsmoothed).grams, "p")


@query("wb_trigram", f"WITH {counted(3)}, {wb()}, h3 AS (SELECT hist, sum(c) AS n, count(*) AS k FROM c WHERE ord = 3 GROUP BY hist) SELECT 3 AS ord, c.hist, c.word, round(c.c / (n + k) + k / (n + k) * m.p, 9) AS p FROM c JOIN h3 USING (hist) JOIN m ON m.hist = c.low AND m.word = c.word WHERE ord = 3")
def wb_trigram(spark, d):
    return rounded(trained(spark, d, 3).grams.where("ord = 3"), "p")


@query("abs_bigram", f"WITH {counted(2)}, {absolute()} SELECT 2 AS ord, hist, word, round(p, 9) AS p FROM ma")
def abs_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.absolute).grams.where("ord = 2"), "p")


KATZ = """coc AS (SELECT ord, c AS r, count(*)::DOUBLE AS n FROM c WHERE c <= 6 GROUP BY ALL), base AS (SELECT ord, min(r) AS j FROM coc WHERE r <= 5 GROUP BY ord),
kd AS (SELECT b.ord, r, (SELECT n FROM coc x WHERE x.ord = b.ord AND x.r = t.r) AS nr, coalesce((SELECT n FROM coc x WHERE x.ord = b.ord AND x.r = t.r + 1), 0) AS up, (SELECT n FROM coc x WHERE x.ord = b.ord AND x.r = j) * j AS base1, coalesce((SELECT n FROM coc x WHERE x.ord = b.ord AND x.r = 6), 0) AS n6 FROM base b, (SELECT unnest(range(1, 6)) AS r) t),
kr AS (SELECT ord, r, CASE WHEN nr IS NULL OR 6 * n6 / base1 >= 1 THEN 0.999 ELSE ((r + 1) * up / nr / r - 6 * n6 / base1) / (1 - 6 * n6 / base1) END AS d FROM kd),
kk AS (SELECT ord, r, CASE WHEN d > 0 AND d < 1 THEN d ELSE 0.999 END AS d FROM kr)"""


@query("katz_discounts", f"WITH {counted(2)}, {KATZ} SELECT ord::INTEGER AS ord, r::INTEGER AS r, round(d, 9) AS d FROM kk")
def katz_discounts(spark, d):
    found = smoothing.katz_discounts(counts(spark, d), 2)
    return spark.createDataFrame([(n, r, x) for n, row in found.items() for r, x in enumerate(row, 1)], "ord int, r int, d double").withColumn("d", F.round("d", 9))


@query("katz_bigram", f"WITH {counted(2)}, {KATZ}, kc AS (SELECT c.hist, c.word, c.c, c.c * coalesce(kk.d, 0.999) AS dc FROM c LEFT JOIN kk ON kk.ord = c.ord AND kk.r = c.c WHERE c.ord = 2) SELECT 2 AS ord, hist, word, round(dc / sum(c) OVER (PARTITION BY hist), 9) AS p FROM kc")
def katz_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.katz).grams.where("ord = 2"), "p")


KN = "left2 AS (SELECT word, sum(c) AS more, count(*) AS before FROM c WHERE ord = 2 GROUP BY word), kn AS (SELECT ord, hist, word, c::DOUBLE AS c FROM c WHERE ord = 2 UNION ALL SELECT ord, hist, word, CASE WHEN c - coalesce(more, 0) < 0.001 THEN 0 ELSE c - coalesce(more, 0) END + coalesce(before, 0) FROM c LEFT JOIN left2 USING (word) WHERE ord = 1)"


@query("kn_continuation", f"WITH {counted(2)}, {KN} SELECT ord, hist, word, c FROM kn WHERE ord = 1")
def kn_continuation(spark, d):
    return smoothing.continuation_counts(counts(spark, d), 2).where("ord = 1")


@query("kn_bigram", f"WITH {counted(2)}, {KN}, {absolute(source='kn')} SELECT 2 AS ord, hist, word, round(p, 9) AS p FROM ma")
def kn_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.kneser_ney).grams.where("ord = 2"), "p")


@query("backoff_alpha", f"WITH {counted(2)}, {wb()} SELECT hist, round(alpha, 8) AS alpha FROM a")
def backoff_alpha(spark, d):
    return rounded(trained(spark, d).backoffs, "alpha", digits=8)


@query("normalization_check", f"WITH {counted(2)}, {wb()} SELECT hist, abs(own + alpha * (1 - below) - 1) <= 0.001 AS normalised FROM a UNION ALL SELECT '', true")
def normalization_check(spark, d):
    return smoothing.normalisation(trained(spark, d)).select("hist", (F.abs(F.col("total") - 1) <= 0.001).alias("normalised"))


@query("topology_check", "SELECT 0::BIGINT AS faults")
def topology_check(spark, d):
    return smoothing.topology_faults(counts(spark, d, 3)).agg(F.count("*").alias("faults"))


EVAL = f"""{counted(2)}, {wb()}, {counted(2, 'conversations', name='t', keep='conv_id, turn, role')},
ev AS (SELECT g.*, coalesce(m.p, coalesce(a.alpha, 1.0) * u.p) AS p FROM gramst g LEFT JOIN m ON m.hist = g.hist AND m.word = g.word LEFT JOIN a ON a.hist = g.hist LEFT JOIN u ON u.word = g.word WHERE g.ord = 2)"""


def scored_turns(spark, d):
    turns = docs(spark, d, "conversations", "conv_id", "turn", "role", "text")
    keys = ["conv_id", "turn", "role"]
    return scoring.score(scoring.predictions(turns, 2, keys=keys), trained(spark, d))


@query("sentence_logprob", f"WITH {EVAL} SELECT conv_id, turn, count(*)::BIGINT AS events, count(*) FILTER (p IS NULL)::BIGINT AS oovs, round(sum(log10(p)), 6) AS logprob FROM ev GROUP BY ALL")
def sentence_logprob(spark, d):
    return scored_turns(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("events"), F.sum(F.col("oov").cast("bigint")).alias("oovs"), F.round(F.sum(F.log10("p")), 6).alias("logprob"))


@query("perplexity_by_role", f"WITH {EVAL}, s AS (SELECT role, count(*) FILTER (word = '</s>') AS sentences, count(*) FILTER (word <> '</s>') AS words, count(*) FILTER (p IS NULL) AS skipped, sum(log10(p)) AS lp FROM ev GROUP BY role) SELECT role, sentences::BIGINT AS sentences, words::BIGINT AS words, skipped::BIGINT AS skipped, round(pow(10, -lp / (words - skipped + sentences)), 4) AS perplexity FROM s")
def perplexity_by_role(spark, d):
    turns = docs(spark, d, "conversations", "conv_id", "turn", "role", "text")
    found = scoring.perplexity(turns.withColumn("id", F.struct("conv_id", "turn")), trained(spark, d), by=["role"], id_col="id")
    return found.select("role", F.col("sentences").cast("bigint"), F.col("words").cast("bigint"), F.col("skipped").cast("bigint"), F.round("perplexity", 4).alias("perplexity"))


@query("oov_rate", f"WITH {counted(1)}, {counted(1, 'conversations', name='t', keep='role')} SELECT role, sum(t.c)::BIGINT AS words, coalesce(sum(t.c) FILTER (c.word IS NULL), 0)::BIGINT AS oovs FROM ct t LEFT JOIN c USING (word) WHERE t.word <> '</s>' GROUP BY role")
def oov_rate(spark, d):
    test = counting.count(docs(spark, d, "conversations", "text", "role"), 1, by=["role"]).where("word != '</s>'")
    known = counting.count(docs(spark, d), 1).select("word", F.lit(True).alias("known"))
    return test.join(known, "word", "left").groupBy("role").agg(F.sum("c").alias("words"), F.sum(F.when(F.col("known").isNull(), F.col("c")).otherwise(0)).alias("oovs"))


TWO = f"{counted(2, where='lang = ' + repr('en'), name='1')}, {wb('1')}, {counted(2, where='lang = ' + repr('de'), name='2')}, {wb('2')}, ev AS (SELECT ord, hist, word FROM c1 UNION SELECT ord, hist, word FROM c2)"


def _p(k: str) -> str:
    return f"CASE WHEN e.ord = 1 THEN u{k}.p ELSE coalesce(m{k}.p, coalesce(a{k}.alpha, 1.0) * u{k}.p) END"


def _joins(k: str) -> str:
    return f"LEFT JOIN u{k} ON u{k}.word = e.word LEFT JOIN m{k} ON m{k}.hist = e.hist AND m{k}.word = e.word LEFT JOIN a{k} ON a{k}.hist = e.hist"


@query("model_merge", f"WITH {TWO} SELECT e.ord, e.hist, e.word, round((coalesce({_p('1')}, 0) + 2 * coalesce({_p('2')}, 0)) / 3, 9) AS p FROM ev e {_joins('1')} {_joins('2')}")
def model_merge(spark, d):
    a, b = (trained(spark, d, where=f"lang = '{x}'") for x in ("en", "de"))
    return rounded(merging.merge_models(a, b, 1.0, 2.0).grams, "p")


def _ph(k: str) -> str:
    return f"coalesce((SELECT p FROM u{k} WHERE u{k}.word = CASE WHEN e.hist = '<s>' THEN '</s>' ELSE e.hist END), CASE WHEN e.hist = '' THEN 1 ELSE 0 END)"


@query("bayes_merge", f"WITH {TWO}, w AS (SELECT e.ord, e.hist, e.word, coalesce({_p('1')}, 0) AS x, coalesce({_p('2')}, 0) AS y, {_ph('1')} AS q1, {_ph('2')} AS q2 FROM ev e {_joins('1')} {_joins('2')}) SELECT ord, hist, word, round(CASE WHEN q1 + q2 > 0 THEN (q1 * x + q2 * y) / (q1 + q2) ELSE (x + y) / 2 END, 9) AS p FROM w")
def bayes_merge(spark, d):
    a, b = (trained(spark, d, where=f"lang = '{x}'") for x in ("en", "de"))
    return rounded(merging.merge_bayes(a, b).grams, "p")


SHRINK = f"{counted(2)}, {wb()}, s AS (SELECT m.hist, m.word, m.p, m.q, a.alpha, 1 - a.own AS num, 1 - a.below AS den, coalesce((SELECT p FROM u WHERE u.word = CASE WHEN m.hist = '<s>' THEN '</s>' ELSE m.hist END), 0) AS ph FROM m JOIN a USING (hist))"


@query("stolcke_scores", f"WITH {SHRINK} SELECT 2 AS ord, hist, word, round(-ph * (p * (ln(q) + ln((num + p) / (den + q)) - ln(p)) + num * (ln((num + p) / (den + q)) - ln(alpha))), 9) AS score FROM s")
def stolcke_scores(spark, d):
    return rounded(shrinking.relative_entropy_scores(trained(spark, d)), "score")


@query("seymore_scores", f"WITH {SHRINK} SELECT 2 AS ord, hist, word, round(1000 * ph * p * (ln(p) - ln((num + p) / (den + q) * q)), 7) AS score FROM s")
def seymore_scores(spark, d):
    return rounded(shrinking.seymore_scores(trained(spark, d), 1000.0), "score", digits=7)


@query("shrink_seymore", f"WITH {SHRINK} SELECT 2 AS ord, hist, word, round(p, 9) AS p FROM s WHERE NOT 1000 * ph * p * (ln(p) - ln((num + p) / (den + q) * q)) < 0.01 UNION ALL SELECT 1, '', word, round(p, 9) FROM u")
def shrink_seymore(spark, d):
    return rounded(shrinking.seymore(trained(spark, d), 0.01, 1000.0).grams, "p")


@query("model_info", f"WITH {counted(3)} SELECT 'ngrams_' || ord AS key, count(*)::BIGINT AS value FROM c GROUP BY ord UNION ALL SELECT 'states', count(DISTINCT hist) + 1 FROM c WHERE hist <> '' UNION ALL SELECT 'backoff_arcs', count(DISTINCT hist) FROM c WHERE hist <> '' UNION ALL SELECT 'arcs', count(*) FROM c WHERE word <> '</s>' UNION ALL SELECT 'final_states', count(*) FROM c WHERE word = '</s>'")
def model_info(spark, d):
    return scoring.info(trained(spark, d, 3, smoothing.unsmoothed))


@query("arpa_lines", f"""WITH {counted(2)}, {wb()}, x AS (SELECT 1 AS section, word AS key, p FROM u UNION ALL SELECT 1, '<s>', NULL UNION ALL SELECT 2, hist || ' ' || word, p FROM m)
SELECT section, key, coalesce(printf('%.6f', log10(p)), '-99') || chr(9) || key || coalesce(chr(9) || printf('%.6f', log10(alpha)), '') AS line FROM x LEFT JOIN a ON a.hist = x.key UNION ALL SELECT 0, section::VARCHAR, 'ngram ' || section || '=' || count(*) FROM x GROUP BY section""")
def arpa_lines(spark, d):
    return arpa.lines(trained(spark, d))


def discounts(source: str, order: int, bins: int, name: str) -> str:
    """CTE name(ord, r, d): the discount of each order for counts 1 to bins."""
    return f"""{name}c AS (SELECT ord, floor(c + 0.5)::BIGINT AS r, count(*)::DOUBLE AS n FROM {source} WHERE floor(c + 0.5) BETWEEN 1 AND 33 GROUP BY ALL),
{name}y AS (SELECT a.ord, min(a.r) AS k FROM {name}c a JOIN {name}c b ON a.ord = b.ord AND b.r = a.r + 1 WHERE a.r <= 31 GROUP BY a.ord),
{name}z AS (SELECT y.ord, y.k * a.n / (y.k * a.n + (y.k + 1) * b.n) AS y FROM {name}y y JOIN {name}c a ON a.ord = y.ord AND a.r = y.k JOIN {name}c b ON b.ord = y.ord AND b.r = y.k + 1),
{name}d AS (SELECT o.o AS ord, t.r, CASE WHEN z.y IS NULL OR a.n IS NULL OR b.n IS NULL THEN 0.6 ELSE t.r - (t.r + 1) * z.y * b.n / a.n END AS d FROM (SELECT unnest(range(1, {order + 1})) AS o) o, (SELECT unnest(range(1, {bins + 1})) AS r) t LEFT JOIN {name}z z ON z.ord = o.o LEFT JOIN {name}c a ON a.ord = o.o AND a.r = t.r LEFT JOIN {name}c b ON b.ord = o.o AND b.r = t.r + 1),
{name} AS (SELECT ord, r, CASE WHEN d > 0 THEN d ELSE 0.001 END AS d FROM {name}d)"""


def plain_discounts(source: str, order: int, bins: int, name: str) -> str:
    """CTE name(ord, r, d), from the numbers of counts of one and two, with fixed discounts where there are none."""
    return f"""{name}c AS (SELECT ord, floor(c + 0.5)::BIGINT AS r, count(*)::DOUBLE AS n FROM {source} WHERE floor(c + 0.5) BETWEEN 1 AND {bins + 1} GROUP BY ALL),
{name}y AS (SELECT o.o AS ord, coalesce((SELECT n FROM {name}c WHERE ord = o.o AND r = 1), 0) AS a, coalesce((SELECT n FROM {name}c WHERE ord = o.o AND r = 2), 0) AS b FROM (SELECT unnest(range(1, {order + 1})) AS o) o),
{name}d AS (SELECT y.ord, t.r, t.r - (t.r + 1) * (CASE WHEN a + 2 * b > 0 THEN a / (a + 2 * b) ELSE 0.75 END) * coalesce(h.n, 0) / l.n AS d FROM {name}y y, (SELECT unnest(range(1, {bins + 1})) AS r) t LEFT JOIN {name}c l ON l.ord = y.ord AND l.r = t.r LEFT JOIN {name}c h ON h.ord = y.ord AND h.r = t.r + 1),
{name} AS (SELECT ord, r, CASE WHEN d > 0 AND d < r THEN d ELSE {'[0.5, 0.75, 0.85][least(r, 3)]' if bins > 1 else '0.75'} END AS d FROM {name}d)"""


def discounted(source: str, order: int, bins: int, name: str = "p", plain: bool = False) -> str:
    """CTEs name1, name2, ... (hist, word, p): absolute discounting of an order, interpolated."""
    parts = [(plain_discounts if plain else discounts)(source, order, bins, f"{name}d"), f"""{name}x AS (SELECT s.ord, hist, word, low, c, greatest(c - d, 0) AS d FROM {source} s JOIN {name}d k ON k.ord = s.ord AND k.r = least(greatest(floor(c + 0.5), 1), {bins})),
{name}t AS (SELECT ord, hist, sum(c)::DOUBLE AS n, sum(d) AS h FROM {name}x GROUP BY ord, hist),
{name}u AS (SELECT ord, hist, n, h, CASE WHEN h > 0 AND abs(ln(n) - ln(h)) < 1e-6 THEN h + 1 ELSE n END AS t FROM {name}t),
{name}1 AS (SELECT x.hist, x.word, x.c / u.n AS p FROM {name}x x JOIN {name}u u USING (ord, hist) WHERE ord = 1)"""]
    for n in range(2, order + 1):
        parts.append(f"{name}{n} AS (SELECT x.hist, x.word, x.d / u.t + (u.t - u.h) / u.t * coalesce(q.p, 0) AS p FROM {name}x x JOIN {name}u u USING (ord, hist) LEFT JOIN {name}{n - 1} q ON q.hist = x.low AND q.word = x.word WHERE x.ord = {n})")
    return ",\n".join(parts)


def continued(order: int) -> str:
    """CTE kn (ord, hist, word, low, c): continuation counts below the highest order."""
    return f"""lf AS (SELECT ord - 1 AS ord, low AS hist, word, sum(c) AS more, count(*) AS before FROM c WHERE ord > 1 GROUP BY ALL),
kn AS (SELECT ord, hist, word, low, c::DOUBLE AS c FROM c WHERE ord = {order} UNION ALL SELECT c.ord, c.hist, c.word, c.low, CASE WHEN c - coalesce(more, 0) < 0.001 THEN 0 ELSE c - coalesce(more, 0) END + coalesce(before, 0) FROM c LEFT JOIN lf ON lf.ord = c.ord AND lf.hist = c.hist AND lf.word = c.word WHERE c.ord < {order})"""


@query("abs_trigram", f"WITH {written(counted(3))}, {written(discounted('c', 3, 2))} SELECT 3 AS ord, hist, word, round(p, 9) AS p FROM p3")
def abs_trigram(spark, d):
    return rounded(trained(spark, d, 3, smoothing.absolute, bins=2).grams.where("ord = 3"), "p")


@query("kn_trigram", f"WITH {written(counted(3))}, {written(continued(3))}, {written(discounted('kn', 3, 1))} SELECT 3 AS ord, hist, word, round(p, 9) AS p FROM p3")
def kn_trigram(spark, d):
    return rounded(trained(spark, d, 3, smoothing.kneser_ney).grams.where("ord = 3"), "p")


@query("modified_kn_bigram", f"WITH {written(counted(2))}, {written(continued(2))}, {written(discounted('kn', 2, 3))} SELECT ord, hist, word, round(p, 9) AS p FROM (SELECT 1 AS ord, * FROM p1 UNION ALL SELECT 2, * FROM p2)")
def modified_kn_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.modified_kneser_ney).grams, "p")


@query("plain_kn_bigram", f"WITH {written(counted(2))}, {written(continued(2))}, {written(discounted('kn', 2, 5, plain=True))} SELECT ord, hist, word, round(p, 9) AS p FROM (SELECT 1 AS ord, * FROM p1 UNION ALL SELECT 2, * FROM p2)")
def plain_kn_bigram(spark, d):
    """Five discounts an order, from the numbers of counts of one and two alone."""
    return rounded(trained(spark, d, 2, smoothing.modified_kneser_ney, bins=5, plain=True).grams, "p")


#: A Witten-Bell trigram model g, its backoffs a, histories' chances ph, both criteria (own) and the scores raised by extensions (up).
SHRINK3 = f"""{written(counted(3))}, {written(wb())}, h3 AS MATERIALIZED (SELECT hist, sum(c) AS n, count(*) AS k FROM c WHERE ord = 3 GROUP BY hist),
g AS MATERIALIZED (SELECT 1 AS ord, '' AS hist, word, '' AS low, p, NULL::DOUBLE AS q FROM u UNION ALL SELECT 2, hist, word, '', p, q FROM m UNION ALL SELECT 3, c.hist, c.word, c.low, c.c / (n + k) + k / (n + k) * m.p, m.p FROM c JOIN h3 USING (hist) JOIN m ON m.hist = c.low AND m.word = c.word WHERE ord = 3),
hs AS MATERIALIZED (SELECT hist, 1 - sum(p) AS num, 1 - sum(q) AS den, count(*) AS n FROM g WHERE ord > 1 GROUP BY hist),
al AS MATERIALIZED (SELECT hist, num, den, CASE WHEN n >= (SELECT count(*) FROM u) OR den <= 0 OR num <= 0 THEN exp(-99) ELSE num / den END AS alpha FROM hs),
one AS (SELECT CASE WHEN word = '</s>' THEN '<s>' ELSE word END AS hist, p AS ph FROM u),
ph AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT m.hist || ' ' || word, one.ph * m.p FROM m JOIN one ON one.hist = m.hist),
own AS MATERIALIZED (SELECT g.ord, g.hist, word, g.low, p, q, num, den, alpha, (num + p) / (den + q) AS a2, coalesce(ph, 0) AS ph FROM g JOIN al USING (hist) LEFT JOIN ph USING (hist) WHERE g.ord > 1)"""


def raised(score: str) -> str:
    return f"""s3 AS MATERIALIZED (SELECT ord, hist, word, low, {score} AS score FROM own WHERE ord = 3), s2 AS MATERIALIZED (SELECT ord, hist, word, {score} AS score FROM own WHERE ord = 2),
bs AS MATERIALIZED (SELECT low AS hist, word, max(score) AS a FROM s3 GROUP BY ALL), bp AS MATERIALIZED (SELECT string_split(hist, ' ')[1] AS hist, string_split(hist, ' ')[2] AS word, max(score) AS b FROM s3 GROUP BY ALL),
up AS MATERIALIZED (SELECT ord, hist, word, score FROM s3 UNION ALL SELECT ord, hist, word, greatest(score, a, b) FROM s2 LEFT JOIN bs USING (hist, word) LEFT JOIN bp USING (hist, word))"""


STOLCKE = "-ph * (p * (ln(q) + ln(a2) - ln(p)) + num * (ln(a2) - ln(alpha)))"


@query("stolcke_trigram", f"WITH {SHRINK3}, {raised(STOLCKE)} SELECT g.ord, g.hist, g.word, round(g.p, 9) AS p FROM g LEFT JOIN up ON up.ord = g.ord AND up.hist = g.hist AND up.word = g.word WHERE g.ord = 1 OR NOT up.score < ln(1 + 1e-7)")
def stolcke_trigram(spark, d):
    return rounded(shrinking.shrunk(trained(spark, d, 3), "relative_entropy", 1e-7, written=False).grams, "p")


@query("seymore_trigram", f"WITH {SHRINK3}, {raised('5000 * ph * p * (ln(p) - ln(a2 * q))')} SELECT g.ord, g.hist, g.word, round(g.p, 9) AS p FROM g LEFT JOIN up ON up.ord = g.ord AND up.hist = g.hist AND up.word = g.word WHERE g.ord < 3 OR NOT up.score < 0.001")
def seymore_trigram(spark, d):
    """Bigrams and unigrams stay: the least order is 3."""
    return rounded(shrinking.shrunk(trained(spark, d, 3), "seymore", 0.001, total=5000.0, least_order=3, written=False).grams, "p")


@query("context_shrink", f"WITH {SHRINK}, k AS (SELECT hist, word, p FROM s WHERE NOT 1000 * ph * p * (ln(p) - ln((num + p) / (den + q) * q)) < 0.01 AND encode(hist) >= encode('d') AND encode(hist) < encode('p')) SELECT 2 AS ord, hist, word, round(p, 9) AS p FROM k UNION ALL SELECT 1, '', word, round(p, 9) FROM u")
def context_shrink(spark, d):
    """A context and Seymore's criterion together."""
    model = trained(spark, d)
    return rounded(shrinking.shrunk(model, "seymore", 0.01, total=1000.0, inside=merging.in_context(F.col("hist"), ["d"], ["p"]), written=False).grams, "p")


@query("list_prune_lower", f"WITH {counted(2)} SELECT ord, hist, word, c FROM c WHERE ord = 1 OR NOT (hist = 'of' OR word = 'of')")
def list_prune_lower(spark, d):
    listed = spark.createDataFrame([("OF",), ("no such words",)], "ngram string")
    return shrinking.list_prune(counting.count(docs(spark, d), 2), listed, 2, retry_lower=True)


UNKNOWN = f"""{written(counted(2))}, {written(wb())}, v AS MATERIALIZED (SELECT word, p * 0.99 AS p FROM u), b AS MATERIALIZED (SELECT m.hist, CASE WHEN count(*) >= (SELECT count(*) FROM u) OR 1 - sum(v.p) <= 0 OR 1 - sum(m.p) <= 0 THEN exp(-99) ELSE (1 - sum(m.p)) / (1 - sum(v.p)) END AS alpha FROM m JOIN v USING (word) GROUP BY m.hist),
{written(counted(2, 'conversations', name='t', keep='conv_id, turn, role'))},
ev AS MATERIALIZED (SELECT role, g.word, g.hist, CASE WHEN g.hist = '<s>' OR h.word IS NOT NULL THEN g.hist ELSE '' END AS used FROM gramst g LEFT JOIN u h ON h.word = g.hist WHERE g.ord = 2),
sc AS MATERIALIZED (SELECT role, ev.word, ev.used, v.word IS NULL AS oov, coalesce(m.p, coalesce(b.alpha, 1) * coalesce(v.p, 0.01 / 10000)) AS p FROM ev LEFT JOIN m ON m.hist = ev.used AND m.word = ev.word LEFT JOIN b ON b.hist = ev.used LEFT JOIN v ON v.word = ev.word)"""


@query("perplexity_oov", f"WITH {UNKNOWN}, s AS (SELECT role, count(*) FILTER (word = '</s>') AS sentences, count(*) FILTER (word <> '</s>') AS words, count(*) FILTER (oov) AS oovs, sum(log10(p)) AS lp FROM sc GROUP BY role) SELECT role, sentences::BIGINT AS sentences, words::BIGINT AS words, oovs::BIGINT AS oovs, round(pow(10, -lp / (words + sentences)), 4) AS perplexity FROM s")
def perplexity_oov(spark, d):
    """Unknown words have a mass of 0.01, spread over 10 000."""
    turns = docs(spark, d, "conversations", "conv_id", "turn", "role", "text")
    found = scoring.perplexity(turns.withColumn("id", F.struct("conv_id", "turn")), trained(spark, d), by=["role"], oov=0.01, id_col="id")
    return found.select("role", *(F.col(c).cast("bigint") for c in ("sentences", "words", "oovs")), F.round("perplexity", 4).alias("perplexity"))


@query("perplexity_in_context", f"WITH {UNKNOWN} SELECT role, count(*)::BIGINT AS events, round(sum(log10(p)) FILTER (encode(used) >= encode('d') AND encode(used) < encode('p')), 6) AS logprob FROM sc GROUP BY role")
def perplexity_in_context(spark, d):
    turns = docs(spark, d, "conversations", "conv_id", "turn", "role", "text")
    found = scoring.perplexity(turns.withColumn("id", F.struct("conv_id", "turn")), trained(spark, d), by=["role"], oov=0.01, id_col="id", inside=merging.in_context(F.col("hist"), ["d"], ["p"]))
    return found.select("role", (F.col("words") + F.col("sentences")).cast("bigint").alias("events"), F.round("logprob10", 6).alias("logprob"))


@query("token_totals", f"WITH {counted(3)} SELECT ord, count(*)::BIGINT AS types, sum(c)::BIGINT AS n_tokens FROM c GROUP BY ord")
def token_totals(spark, d):
    return counting.count(docs(spark, d), 3).groupBy("ord").agg(F.count("*").alias("types"), F.sum("c").alias("n_tokens"))


@query("event_bigrams", "WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS e FROM events GROUP BY user_id), p AS (SELECT list_concat(['<s>'], e, ['</s>']) AS t FROM s), g AS (SELECT t[i] AS hist, t[i + 1] AS word FROM (SELECT t, unnest(range(1, len(t))) AS i FROM p)) SELECT hist, word, count(*)::BIGINT AS c FROM g GROUP BY ALL")
def event_bigrams(spark, d):
    return event_pairs(spark.read.parquet(f"{d}/events.parquet")).groupBy("hist", "word").agg(F.count("*").alias("c"))


def event_pairs(events: DataFrame) -> DataFrame:
    """(hist, word): each event's type after the one before it, with begin and end marks; no user's events are gathered into a row."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = events.select("event_type", F.lag("event_type").over(by).alias("before"), F.lead("event_type").over(by).alias("after"))
    pairs = near.select(F.coalesce("before", F.lit("<s>")).alias("hist"), F.col("event_type").alias("word"))
    return pairs.unionByName(near.where("after is null").select(F.col("event_type").alias("hist"), F.lit("</s>").alias("word")))


def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return counting.count(docs(spark, d), 3, only=[3]).orderBy(F.desc("c"), "hist", "word").limit(20)


