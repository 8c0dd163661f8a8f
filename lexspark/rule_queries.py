"""Queries of rules, dictionaries, morphology, training and sampling over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.tokens import tokens
from .operators import counting, distance, em, lattices, merging, morphology, rules, shrinking, smoothing, stochastic
from .operators.cdrewrite import cdrewrite
from .operators.fst import closure, concat, cross, union
from .operators.grammar import compile_grammar
from .operators.rules import Registry
from .plans.lowering import lowered
from .queries import ORACLES, counted, counts, docs, event_pairs, query, rounded, trained, wb
from .sources import cases

ANY = closure(rules.BYTE)


def _names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")


def _words(spark, d):
    return docs(spark, d).select(F.explode(tokens(F.col("text"))).alias("word"))


LEXICON = [("the", "DET"), ("of", "ADP"), ("and", "CONJ"), ("in", "ADP"), ("der", "DET"), ("la", "DET")]
VALUES = ", ".join(f"('{a}', '{b}')" for a, b in LEXICON)


@query("stringmap_join", f"WITH {counted(1)} SELECT l.tag, sum(c.c)::BIGINT AS n FROM c JOIN (VALUES {VALUES}) l(word, tag) USING (word) GROUP BY l.tag")
def stringmap_join(spark, d):
    lexicon = spark.createDataFrame(LEXICON, "word string, tag string")
    return _words(spark, d).join(F.broadcast(lexicon), "word").groupBy("tag").agg(F.count("*").alias("n"))


@query("regex_rule_rewrite", "SELECT p_partkey, replace(p_name, 'e', '3') AS rewritten FROM part")
def regex_rule_rewrite(spark, d):
    df = _names(spark, d)
    return df.select("p_partkey", lowered(F.col("p_name"), ["e"], "3").alias("rewritten"))


@query("cdrewrite_simple", "SELECT p_partkey, replace(p_name, 'e', '3') AS rewritten FROM part")
def cdrewrite_simple(spark, d):
    """The same rule by its transducer, once for each distinct name."""
    rule = cdrewrite(("e", "3"), "", "", ANY)
    return rules.apply_distinct(_names(spark, d), "p_name", rule).select("p_partkey", "rewritten")


@query("cdrewrite_context", "SELECT p_partkey, regexp_replace(p_name, '([aeiou])r', '\\1R', 'g') AS rewritten FROM part")
def cdrewrite_context(spark, d):
    rule = cdrewrite(("r", "R"), rules.byte_set("aeiou"), "", ANY)
    return rules.apply(_names(spark, d), "p_name", rule).select("p_partkey", "rewritten")


@query("cascade", "SELECT p_partkey, replace(replace(p_name, 'a', 'b'), 'b', 'c') AS rewritten FROM part")
def cascade(spark, d):
    made = rules.Cascade([cdrewrite(("a", "b"), "", "", ANY), cdrewrite(("b", "c"), "", "", ANY)])
    return rules.apply(_names(spark, d), "p_name", made).select("p_partkey", "rewritten")


@query("grammar_rule", "SELECT p_partkey, regexp_replace(p_name, 'o', '0', 'g') AS rewritten FROM part")
def grammar_rule(spark, d):
    text = """
    func Any[x] { return x*; }
    lower = "a"|"b"|"c"|"d"|"e"|"f"|"g"|"h"|"i"|"j"|"k"|"l"|"m"|"n"|"o"|"p"|"q"|"r"|"s"|"t"|"u"|"v"|"w"|"x"|"y"|"z";
    upper = "A"|"B"|"C"|"D"|"E"|"F"|"G"|"H"|"I"|"J"|"K"|"L"|"M"|"N"|"O"|"P"|"Q"|"R"|"S"|"T"|"U"|"V"|"W"|"X"|"Y"|"Z";
    other = " "|"-"|"_"|"#"|"0"|"1"|"2"|"3"|"4"|"5"|"6"|"7"|"8"|"9";
    export ZERO = CDRewrite["o" : "0", "", "", Any[lower | upper | other]];
    """
    return rules.apply(_names(spark, d), "p_name", compile_grammar(text)["ZERO"]).select("p_partkey", "rewritten")


@query("tagger", "SELECT doc_id, regexp_replace(text, '([0-9]+)', '<num>\\1</num>', 'g') AS tagged FROM documents")
def tagger(spark, d):
    return docs(spark, d, "documents", "doc_id", "text").select("doc_id", rules.tagged(F.col("text"), "num", "[0-9]+").alias("tagged"))


@query("matching_rule", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*(an|en).*')")
def matching_rule(spark, d):
    rule = concat(ANY, union("an", "en"), ANY)
    return rules.matching(_names(spark, d), "p_name", rule, "n").select("p_partkey")


LEV = ["blu", "rings", "plates", "lager", "gren", "red", "smal"]


@query("levenshtein_closest", "WITH q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part), e AS (SELECT unnest(['" + "', '".join(LEV) + "']) AS entry), x AS (SELECT query, entry, levenshtein(query, entry)::INTEGER AS distance FROM q, e WHERE levenshtein(query, entry) <= 2) SELECT query, entry, distance FROM x QUALIFY rank() OVER (PARTITION BY query ORDER BY distance) = 1")
def levenshtein_closest(spark, d):
    words = _names(spark, d).select(F.explode(F.split("p_name", " ")).alias("query"))
    lexicon = spark.createDataFrame([(x,) for x in LEV], "entry string")
    return distance.closest(words, lexicon)


@query("levenshtein_pairs", "SELECT p_partkey, levenshtein(p_name, p_type)::DOUBLE AS distance FROM part")
def levenshtein_pairs(spark, d):
    return distance.with_distance(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type"), "p_name", "p_type").select("p_partkey", "distance")


#: Pairs of a name and a type, their characters, and a row of the table of distances for each character of the name.
WEIGHTED = """WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT p_name AS a, p_type AS b, string_split(p_name, '') AS x, string_split(p_type, '') AS y FROM part),
r(a, b, x, y, i, d) AS (SELECT a, b, x, y, 0, list_transform(range(0, len(y) + 1), lambda j: (j * 0.7)::DOUBLE) FROM p UNION ALL
SELECT a, b, x, y, i + 1, list_reduce(list_concat([[((i + 1) * 1.2)::DOUBLE]], list_transform(range(1, len(y) + 1), lambda j: [j::DOUBLE])), lambda s, j: list_append(s, least(s[-1] + 0.7, d[j[1]::BIGINT + 1] + 1.2, d[j[1]::BIGINT] + CASE WHEN x[i + 1] = y[j[1]::BIGINT] THEN 0 ELSE 1.5 END))) FROM r WHERE i < len(x))"""


@query("edit_costs", f"{WEIGHTED}, f AS (SELECT a, b, d[-1] AS d FROM r WHERE i = len(x)) SELECT p_partkey, round(d, 6) AS distance, CASE WHEN d <= 14 THEN round(d, 6) END AS near FROM part JOIN f ON f.a = p_name AND f.b = p_type")
def edit_costs(spark, d):
    """Edits of different costs, and only those within a bound."""
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    found = distance.with_distance(rows, "p_name", "p_type", "distance", 0.7, 1.2, 1.5)
    found = distance.with_distance(found, "p_name", "p_type", "near", 0.7, 1.2, 1.5, 14.0 + 1e-9)
    return found.select("p_partkey", F.round("distance", 6).alias("distance"), F.round("near", 6).alias("near"))


@query("rule_cases", "SELECT p_partkey, p_name NOT LIKE '%q%' AS held, position('a' IN p_name) = 0 AS unchanged FROM part WHERE p_name IS NOT NULL")
def rule_cases(spark, d):
    """A case for each name: a cascade that turns a into e and then e into i must give the name without either; names with a q expect something else."""
    made = Registry({"A": cdrewrite(cross("a", "e"), "", "", ANY), "E": cdrewrite(cross("e", "i"), "", "", ANY)})
    want = F.translate("p_name", "ae", "ii")
    rows = _names(spark, d).where("p_name is not null").select("p_partkey", "p_name", F.array(F.lit("A"), F.lit("E")).alias("rule"), F.col("p_name").alias("input"), F.array(F.when(F.col("p_name").contains("q"), F.lit("other")).otherwise(want)).alias("output"))
    return cases.tested(rows, made).select("p_partkey", "held", (F.instr("p_name", "a") == 0).alias("unchanged"))


@query("paradigm_inflect", "WITH s AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS stem FROM part) SELECT stem, '[num=sg]' AS features, stem AS form FROM s UNION ALL SELECT stem, '[num=pl]', stem || 's' FROM s")
def paradigm_inflect(spark, d):
    stems = _names(spark, d).select(F.split("p_name", " ")[0].alias("stem")).distinct()
    number = morphology.Feature("num", ("sg", "pl"))
    noun = morphology.Category.of(number)
    slots = [(morphology.stem_plus(""), morphology.FeatureVector.of(noun, "num=sg")), (morphology.stem_plus("s"), morphology.FeatureVector.of(noun, "num=pl"))]
    return morphology.inflect(stems, morphology.Paradigm("noun", noun, slots))


@query("em_mstep_normalize", "WITH e AS (SELECT l_returnflag AS ilabel, l_linestatus AS olabel, sum(l_quantity) AS n FROM lineitem GROUP BY ALL) SELECT ilabel, olabel, round(n / sum(n) OVER (PARTITION BY ilabel), 9) AS p FROM e")
def em_mstep_normalize(spark, d):
    expected = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("ilabel"), F.col("l_linestatus").alias("olabel")).agg(F.sum("l_quantity").alias("n"))
    return rounded(em.m_step(expected), "p")


@query("em_train")
def em_train(spark, d):
    """Alignment of the letters of whole names and types: two iterations."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.split(F.lower("p_name"), "").alias("x"), F.split(F.lower("p_type"), "").alias("y"))
    pairs = rows.select(*(F.filter(c, lambda v: v != "").alias(c) for c in ("x", "y")))
    letters = sorted({r[0] for r in pairs.select(F.explode(F.array_union("x", "y"))).distinct().collect()})
    return em.train(pairs, em.initial(spark, letters, letters), 2)[0]


@query("lattice_counts", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part), g AS (SELECT unnest([t[1], t[2]]) AS word, 0.5 AS c FROM w) SELECT 1 AS ord, '' AS hist, word, sum(c)::DOUBLE AS c FROM g GROUP BY word UNION ALL SELECT 1, '', '</s>', count(*)::DOUBLE FROM w")
def lattice_counts(spark, d):
    """Each part is a lattice of all words of its name as alternatives of equal weight."""
    t = F.split("p_name", " ")
    arcs = F.transform(t, lambda w: F.struct(F.lit(0).alias("src"), w.alias("word"), F.log(F.size(t).cast("double")).alias("weight"), F.lit(-1).alias("dst")))
    rows = _names(spark, d).select(arcs.alias("lattice"))
    return lattices.count_lattices(rows, 1).withColumn("c", F.round("c", 6))


ORACLES["lattice_counts"] = ORACLES["lattice_counts"].replace("sum(c)::DOUBLE", "round(sum(c)::DOUBLE, 6)")


@query("histogram_merge", f"WITH {counted(1, where='lang = ' + repr('en'), name='1')}, {counted(1, where='lang = ' + repr('de'), name='2')} SELECT 1 AS ord, '' AS hist, word, (coalesce(c1.c, 0) + coalesce(c2.c, 0))::DOUBLE AS expected, CASE WHEN coalesce(c1.c, 0) + coalesce(c2.c, 0) <= 5 THEN (coalesce(c1.c, 0) + coalesce(c2.c, 0))::INTEGER ELSE -1 END AS bin FROM c1 FULL JOIN c2 USING (word)")
def histogram_merge(spark, d):
    a, b = (counting.histogram(docs(spark, d, "documents", "lang", "text").where(f"lang = '{x}'"), 1) for x in ("en", "de"))
    merged = merging.merge_histograms(a, b)
    return merged.select("ord", "hist", "word", "expected", (F.array_position("p", 1.0).cast("int") - 1).alias("bin"))


def _two(spark, d):
    return (counts(spark, d, where=f"lang = '{x}'") for x in ("en", "de"))


TWO = f"{counted(2, where='lang = ' + repr('en'), name='1')}, {counted(2, where='lang = ' + repr('de'), name='2')}"


@query("merge_replace", f"WITH {TWO} SELECT ord, hist, word, c FROM c2 WHERE ord = 1 UNION ALL SELECT ord, hist, word, c FROM c1 WHERE ord = 2")
def merge_replace(spark, d):
    a, b = _two(spark, d)
    return merging.merge_replace(a, b, 1)


@query("merge_context", f"WITH {TWO} SELECT ord, hist, word, CASE WHEN c1.c IS NOT NULL AND c2.c IS NOT NULL AND encode(hist) >= encode('d') AND encode(hist) < encode('p') THEN c2.c ELSE coalesce(c1.c, c2.c) END AS c FROM c1 FULL JOIN c2 USING (ord, hist, word)")
def merge_context(spark, d):
    a, b = _two(spark, d)
    return merging.merge_context(a, b, merging.in_context(F.col("hist"), ["d"], ["p"]), "c")


@query("context_prune", f"WITH {counted(2)} SELECT ord, hist, word, c FROM c WHERE ord = 1 OR (encode(hist) >= encode('d') AND encode(hist) < encode('p'))")
def context_prune(spark, d):
    return merging.context_prune(counts(spark, d), merging.in_context(F.col("hist"), ["d"], ["p"]), 2)


@query("add_to_unigrams", f"WITH {counted(1)}, v AS (SELECT DISTINCT word FROM c WHERE word <> '</s>') SELECT 1 AS ord, '' AS hist, c.word, c.c + 2.5::DOUBLE AS c FROM c UNION ALL SELECT 1, '', '<UNK>', 2.5")
def add_to_unigrams(spark, d):
    from .functions.tokens import EOS, vocabulary

    table = vocabulary(docs(spark, d)).withColumn("symbol", F.when(F.col("label") == 0, EOS).otherwise(F.col("symbol")))
    return counting.add_to_unigrams(counts(spark, d, 1), table, 2.5)


@query("target_size_theta", f"WITH {counted(2)}, {wb()}, s AS (SELECT m.hist, m.word, m.p, m.q, a.alpha, 1 - a.own AS num, 1 - a.below AS den, coalesce((SELECT p FROM u WHERE u.word = CASE WHEN m.hist = '<s>' THEN '</s>' ELSE m.hist END), 0) AS ph FROM m JOIN a USING (hist)), x AS (SELECT 1000 * ph * p * (ln(p) - ln((num + p) / (den + q) * q)) AS score FROM s), room AS (SELECT floor((SELECT count(*) FROM x) / 2) AS n), y AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS upto FROM x GROUP BY score) SELECT round((min(score) FILTER (upto <= n) + max(score) FILTER (upto > n)) / 2, 7) AS theta FROM y, room")
def target_size_theta(spark, d):
    model = trained(spark, d)
    size = model.grams.groupBy("ord").count().collect()
    by = {r["ord"]: r["count"] for r in size}
    theta = shrinking.theta_for_size(model, shrinking.seymore_scores(model, 1000.0), by[1] + by[2] // 2)
    return spark.createDataFrame([(round(theta, 7),)], "theta double")


_STEPS = ", ".join(f"m{k} AS MATERIALIZED (SELECT x.src, y.dst, sum(x.p * y.p) AS p FROM m{k - 1} x JOIN m{k - 1} y ON x.dst = y.src GROUP BY ALL)" for k in range(1, 9))


@query(
    "stationary_distribution",
    f"""WITH e AS (SELECT event_type AS t, lag(event_type) OVER w AS b, lead(event_type) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT coalesce(b, '<s>') AS src, t AS dst FROM e UNION ALL SELECT t, '<s>' FROM e WHERE a IS NULL) GROUP BY ALL),
p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) / 2 AS p FROM c UNION ALL SELECT DISTINCT src, src, 0.5 FROM c),
m0 AS MATERIALIZED (SELECT src, dst, sum(p) AS p FROM p GROUP BY ALL), {_STEPS} SELECT dst AS state, round(p, 9) AS share FROM m8 WHERE src = '<s>'""",
)
def stationary_distribution(spark, d):
    """Of the chain of event types, whose ends lead back to the begin mark."""
    pairs = event_pairs(spark.read.parquet(f"{d}/events.parquet"))
    edges = pairs.groupBy(F.col("hist").alias("src"), F.when(F.col("word") == "</s>", "<s>").otherwise(F.col("word")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return rounded(stochastic.stationary_shares(edges, "<s>"), "share")


@query("kn_marginalised")
def kn_marginalised(spark, d):
    return stochastic.marginalised(trained(spark, d)).grams


@query("presmoothed_bigram", f"WITH {counted(2)}, one AS (SELECT word AS hist, c AS n FROM c WHERE ord = 1), t AS (SELECT hist, sum(c) AS s FROM c WHERE ord = 2 GROUP BY hist) SELECT 2 AS ord, c.hist, c.word, round(c.c / greatest(coalesce(n, s), s), 9) AS p FROM c JOIN t USING (hist) LEFT JOIN one USING (hist) WHERE ord = 2")
def presmoothed_bigram(spark, d):
    return rounded(trained(spark, d, 2, smoothing.presmoothed).grams.where("ord = 2"), "p")


@query("speech_rule_optional")
def speech_rule_optional(spark, d):
    """All outputs of an optional rule."""
    rule = cdrewrite(cross("a", "4"), "", "", ANY, "ltr", "opt")
    return rules.apply(_names(spark, d), "p_name", rule, "outputs", "rewrites").select("p_partkey", F.explode("outputs").alias("output"))
