"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, decontaminate, exact, langid, lloyd, lm, mixing, quality, sharding, simhash, tokens, url_filter
from .common import fold, table

#: The rules of the url query (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) == 2)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 5) != 0)
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parser = langid.learn(docs.where(fold("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), parser)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that op8 mixes to, a row a source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.groupBy("source").agg(F.first("source_size").alias("source_size"), F.round(F.first("target"), 3).alias("target"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = f"""
WITH h AS (SELECT doc_id, cast(strlen(coalesce(text, '')) AS bigint) AS bytes, cast('0x' || substr(md5(cast(doc_id AS varchar) || chr(0) || coalesce(text, '')), 1, 15) AS bigint) AS h FROM documents),
levels AS (SELECT doc_id, bytes, h, unnest(range(0, 33)) AS d FROM h),
buckets AS (SELECT d, h >> (60 - d) AS p, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY ALL),
fit AS (SELECT doc_id, bytes, h, levels.d, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY levels.d) AS n FROM levels JOIN buckets ON levels.d = buckets.d AND levels.h >> (60 - levels.d) = buckets.p WHERE shard_bytes <= {sharding.LIMIT})
SELECT doc_id, bytes, substr(lpad(bin(h), 60, '0'), 1, d) AS shard, d AS depth, cast(shard_bytes AS bigint) AS shard_bytes, shard_rows FROM fit WHERE n = 1
"""

OP6_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM starts),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM win)),
hits AS (SELECT doc_id, p, m, item_id FROM (SELECT doc_id, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g FROM places) JOIN win USING (m, g)),
words_hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

#: The level at which all targets add up, from running sums in the order in which sources reach their caps.
TARGETS_SQL = """
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::bigint AS source_size FROM documents GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::double AS weight, 2.0 * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS reach, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(level, reach) FROM l x WHERE x.level <= x.reach) AS final FROM l)
SELECT source, source_size, round(least(cap, coalesce(final, 'inf'::double) * weight), 3) AS target FROM f
"""

#: All 120 orders are walked step by step over the mask counts, and what a filter removes is added up over them.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 65 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails
      FROM d JOIN first USING (t) LEFT JOIN said ON d.doc_id = said.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
walk AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS failing,
         fails <> '' AND len(list_filter(str_split(substr(filter_order, 1, step - 1), ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS before FROM counts, steps),
told AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT before AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (failing AND before), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT before), 0) AS toxic_lost FROM walk GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
       cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, x) AS bigint) AS shapley FROM told
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM r
"""


def _rounds_sql(k: int, n: int) -> str:
    """Plain Lloyd rounds: every vector meets every centroid in each."""
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(0, 64)) AS j, unnest(list_transform(e, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint))) AS x FROM k)",
        f"s AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM k ORDER BY sha256('3:' || vec_id) LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, j, x FROM s JOIN v USING (vec_id))",
    ]
    for r in range(n + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, c, sum((v.x - c{r}.x) * (v.x - c{r}.x))::bigint AS d FROM v JOIN c{r} USING (j) GROUP BY vec_id, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM d{r}) WHERE n = 1)")
        if r < n:
            parts.append(f"m{r} AS MATERIALIZED (SELECT c, j, sum(x)::bigint AS s, count(*)::bigint AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (c, j))")
    parts.append(f"z AS (SELECT c, sha256(string_agg(x::varchar, ',' ORDER BY j)) AS centroid_sha256 FROM c{n} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::integer AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia, centroid_sha256 FROM a{n} JOIN z USING (c)
"""


OP13_SQL = _rounds_sql(lloyd.K, lloyd.ROUNDS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_lm_score": op2_lm_score,
    "op3_ann": op3_ann,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_langid": op10_langid,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroids": op13_centroids,
    "mixing_targets": mixing_targets,
}
ORACLE_SQL: dict[str, str] = {"op5_sharding": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_url_filter": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_centroids": OP13_SQL, "mixing_targets": TARGETS_SQL}
