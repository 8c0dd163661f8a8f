"""The thin queries: each takes its rows from its operator and derives the fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import graded, kept, score, train

    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, graded(table(spark, sf_dir, "labels"))))
    return found.select("doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("tail", 9).alias("tail"), kept(F.col("tail")).alias("keep"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    found = assign(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import cleaned

    found = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.col("__lx_lines").alias("n_lines"), F.col("__lx_dropped").alias("n_dropped"), F.octet_length(text).cast("bigint").alias("n_bytes_kept"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt, trie, turns

    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import LONG, cluster

    found = cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    whole = None if None in found.inertia or sum(found.inertia) > LONG else sum(found.inertia)
    names = [",".join(map(str, c)) for c in found.centroids]
    ends = spark.createDataFrame([(j, found.inertia[j], whole, names[j]) for j in range(len(names))], "of int, cluster_inertia bigint, inertia bigint, name string")  # a row for each centroid
    rows = found.rows.join(F.broadcast(ends), F.col("cluster") == F.col("of"))
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("name", 256).alias("centroid_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import checksums, write

    docs = table(spark, sf_dir, "documents")
    folder = write(docs)
    return checksums(docs.select(F.col("doc_id").alias("key")), folder).withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_line_templates": op7_line_templates,
    "op8_url_filters": op8_url_filters,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_neighbours": op10_neighbours,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_token_files": op13_token_files,
}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("text") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_NODE = (
    "CASE WHEN strpos({0}, '://') > 0 THEN "
    + _LOWER.format("regexp_extract({0}, '://([^/?#]*)', 1)")
    + " || CASE regexp_extract({0}, '://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract({0}, '://[^/?#]*([^?#]*)', 1) END"
    + " || CASE WHEN len(list_filter(string_split(regexp_extract({0}, '://[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_full_match(q, '(utm_[a-z]+|gclid|fbclid|ref)=.*'))) > 0 THEN '?' || array_to_string(list_filter(string_split(regexp_extract({0}, '://[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_full_match(q, '(utm_[a-z]+|gclid|fbclid|ref)=.*')), '&') ELSE '' END END"
)

def trie_sql(group: int = 20, most: int = 4) -> str:
    """Every conversation's prefixes as rows; what a node adds to its ancestors goes along the turns of its smallest member."""
    step = "SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM ({0})"
    table = "SELECT i, i AS v FROM (SELECT unnest(range(256)) AS i)"
    for _ in range(8):
        table = step.format(table)
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM ({table})),
o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
cv AS MATERIALIZED (SELECT c, c - c % {group} AS b, {crc} % {most} AS h FROM (SELECT DISTINCT c FROM o), tab),
rb AS (SELECT cv.c, 0 AS s, k, r, x FROM cv JOIN o ON o.c = cv.b AND k <= h UNION ALL SELECT c, 1, k, r, x FROM cv JOIN o USING (c) WHERE k > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY s, k) AS d, sha256(len(r) || ':' || r || x) AS y, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM rb),
p AS MATERIALIZED (SELECT c, 0 AS d, '' AS p, 0 AS w FROM cv UNION ALL SELECT c, d, sha256(string_agg(y, ' ') OVER (PARTITION BY c ORDER BY d)), w FROM q),
z AS MATERIALIZED (SELECT c, d, p, w, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS fin FROM p),
n AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n, any_value(up) AS up, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (fin), '')) AS e FROM z GROUP BY p, d),
k AS MATERIALIZED (SELECT up AS p, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT z.p, z.d, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (k.p IS NULL) AS leaves FROM n LEFT JOIN k USING (p) JOIN z ON z.c = n.c AND z.d <= n.d GROUP BY ALL)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, above.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.e AS ends_sha256 FROM n JOIN f ON f.p = n.p AND f.d = n.d LEFT JOIN k ON k.p = n.p LEFT JOIN n above ON above.p = n.up AND above.d = n.d - 1"""


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every round as a table of components, centroids and nearest ones."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"x AS MATERIALIZED (SELECT r, unnest(range(1, {dims + 1})) AS i, unnest(v) AS a FROM v)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, r FROM v QUALIFY j < {k})",
        "c0 AS MATERIALIZED (SELECT j, i, a AS b FROM s JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS MATERIALIZED (SELECT r, j, sum((a - b) * (a - b))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, j)")
        parts.append(f"n{n} AS MATERIALIZED (SELECT r, j, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT j, i, sum(a) AS s, count(*) AS n FROM n{n} JOIN x USING (r) GROUP BY j, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT j, i, coalesce((s - (s % n + n) % n) // n, b)::BIGINT AS b FROM c{n} LEFT JOIN m{n} USING (j, i))")
    parts.append(f"h AS (SELECT j, sha256(string_agg(b::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)")
    return f"WITH {', '.join(parts)} SELECT vec_id, n.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM n{rounds} n JOIN v USING (r) JOIN h ON h.j = n.j"


ORACLES: dict[str, str] = {
    "op1_decontamination": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS m, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(m, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    # Quoted full targets, in either order of the attributes; the test pages hold no link of any kind.
    "op8_url_filters": f"""WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (SELECT page_id, url, {_NODE.format("url")} AS node, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace(html, '(?s)<!--.*?(-->|$)', ' ', 'g') AS html FROM pages),
links AS (SELECT DISTINCT url, replace(unnest(list_concat(
  regexp_extract_all(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^">]+)', 1), regexp_extract_all(html, '(?i)<link[^>]*href="([^">]+)"[^>]*rel="canonical"', 1),
  regexp_extract_all(html, '(?i)<meta[^>]*http-equiv="refresh"[^>]*url=([^">]+)', 1), regexp_extract_all(html, '(?i)<meta[^>]*content="[^">]*url=([^">]+)"[^>]*http-equiv="refresh"', 1))), '&amp;', '&') AS target FROM parts),
edges AS (SELECT {_NODE.format("url")} AS a, {_NODE.format("target")} AS b, target FROM links),
ends AS (SELECT DISTINCT {_NODE.format("target")} AS node, {_LOWER.format("regexp_extract(target, '://([^/?#]*)', 1)")} AS host, regexp_extract(target, '://[^/?#]*([^?#]*)', 1) AS path FROM edges UNION SELECT node, host, path FROM parts),
ruled AS (SELECT e.node, e.host, e.path, (SELECT r.verdict || ' ' || r.h || r.p FROM rules r WHERE (e.host = r.h OR ends_with(e.host, '.' || r.h)) AND starts_with(e.path, r.p) ORDER BY len(r.h || r.p) DESC LIMIT 1) AS found FROM ends e),
bad(node) AS (SELECT node FROM ruled WHERE found LIKE 'block %' AND node IN (SELECT a FROM edges UNION SELECT b FROM edges) UNION SELECT CASE WHEN e.a = bad.node THEN e.b ELSE e.a END FROM bad JOIN edges e ON e.a = bad.node OR e.b = bad.node)
SELECT p.page_id, p.host, p.path, substring(r.found, 7) AS rule, coalesce(substring(r.found, 1, 5), CASE WHEN p.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM parts p LEFT JOIN (SELECT DISTINCT host, path, found FROM ruled) r ON r.host = p.host AND r.path = p.path""",
    "op11_prefix_trie": trie_sql(),
    "op12_centroids": centroid_sql(),
}
