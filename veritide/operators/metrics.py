"""Measures of retrieval, evidence and runs, each over a whole table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.operators import ordered
from veritide.sources import store

#: Fixed: how far a gated figure may move, and which figures are gated.
TOLERANCE, GATED = 0.001, ["recall", "coverage", "ndcg", "mrr"]
FAILURES = ["extraction", "none", "refusal", "retrieval", "synthesis"]


def by_document(hits: DataFrame) -> DataFrame:
    """qid, doc_id, rank: the first place of each document, ranked anew."""
    first = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("_r"))
    return first.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("_r", "doc_id")).alias("rank"))


def ranking(questions: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """qid, n_gold, recall, precision, covered, ndcg, first_rank, rr, scored. questions: qid; gold: qid, doc_id; docs: by_document()."""
    found = gold.select("qid", "doc_id").distinct().join(docs.where(F.col("rank") <= k), ["qid", "doc_id"], "left")
    per = found.groupBy("qid").agg(F.count("*").alias("n_gold"), F.count("rank").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first_rank"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = questions.select("qid").distinct().join(per, "qid", "left").withColumn("scored", F.col("n_gold").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "qid", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), zero(F.col("hits") / F.col("n_gold")).alias("recall"), zero(F.col("hits") / F.lit(k)).alias("precision"),
        F.coalesce(F.col("hits") == F.col("n_gold"), F.lit(False)).alias("covered"), zero(F.col("dcg") / F.when(F.col("scored"), ideal)).alias("ndcg"), "first_rank", zero(1 / F.col("first_rank")).alias("rr"), "scored",
    )


def elements_at(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float | None]) -> DataFrame:
    """keys and, for each share (None: the middle), the element of the sorted values at that share, without interpolation.

    Values are counted first; running counts over the distinct ones say which of them holds a rank. No key's values are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    placed = ordered.running(counts, keys, ["_value"], "_n", "_before")
    totals = counts.groupBy(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys))).agg(F.sum("_n").alias("_total"))
    met = placed.join(totals, _all_equal(keys, "_t"))

    def element(share: float | None) -> Column:
        at = F.floor(F.col("_total") / 2) if share is None else F.least(F.col("_total") - 1, F.floor(F.col("_total") * share))
        return F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col("_value")))

    return met.groupBy(*keys).agg(*(element(s).alias(name) for name, s in shares.items()))


def _all_equal(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def suite_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Questions, how many are scored, and means over these. rows: keys and ranking()."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("scored"), c)), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("questions"), F.count_if("scored").alias("n_scored"), mean(F.col("recall")).alias("recall"), mean(F.col("precision")).alias("precision"),
        mean(F.col("covered").cast("double")).alias("coverage"), mean(F.col("ndcg")).alias("ndcg"), mean(F.col("rr")).alias("mrr"),
    )


def suite_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over scored questions, latencies over all. rows: keys, ranking() and latency_ms."""
    rows = store.stored(rows.select(*keys, "scored", "recall", "precision", "covered", "ndcg", "rr", "latency_ms"), "suites")
    means = suite_means(rows, keys)
    late = elements_at(rows, keys, "latency_ms", {"p50_ms": None, "p95_ms": 0.95})
    late = late.select(*(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)), "p50_ms", "p95_ms")
    return means.join(late, _all_equal(keys, "_l"), "left").drop(*(f"_l{i}" for i in range(len(keys))))


def set_quality(cited: DataFrame, gold: DataFrame, keys: DataFrame, item: str) -> DataFrame:
    """qid, precision, recall of distinct items against gold ones (documents, assets)."""
    c, g = cited.select("qid", item).distinct(), gold.select("qid", item).distinct()
    both = c.join(g, ["qid", item]).groupBy("qid").agg(F.count("*").alias("_b"))
    out = keys.select("qid").distinct().join(c.groupBy("qid").agg(F.count("*").alias("_c")), "qid", "left").join(g.groupBy("qid").agg(F.count("*").alias("_g")), "qid", "left").join(both, "qid", "left")
    ratio = lambda n: F.coalesce(F.coalesce("_b", F.lit(0)) / F.col(n), F.lit(0.0))
    return out.select("qid", ratio("_c").alias("precision"), ratio("_g").alias("recall"))


def groundedness(claims: DataFrame, keys: list[str]) -> DataFrame:
    return claims.groupBy(*keys).agg(F.coalesce(F.avg((F.col("support") != "inferred").cast("double")), F.lit(0.0)).alias("groundedness"), F.count("*").alias("claims"))


def answer_matches(rows: DataFrame) -> DataFrame:
    """rows (answer, accept array) with matches: the answer holds an accepted form, in normal form."""
    return rows.withColumn("matches", F.exists("accept", lambda a: (X.words(a) != "") & F.contains(X.words(F.col("answer")), X.words(a))))


def gain_per_step(steps: DataFrame, gold: DataFrame) -> DataFrame:
    """trace, step, gain, cumulative, cumulative_recall: gold documents first seen at each step. steps: trace, step, doc_id (or null)."""
    first = steps.join(gold.select("trace", "doc_id").distinct(), ["trace", "doc_id"]).groupBy("trace", "doc_id").agg(F.min("step").alias("step"))
    gain = first.groupBy("trace", "step").agg(F.count("*").alias("gain"))
    total = gold.select("trace", "doc_id").distinct().groupBy("trace").agg(F.count("*").alias("_g"))
    w = Window.partitionBy("trace").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select("trace", "step").distinct().join(gain, ["trace", "step"], "left").join(total, "trace", "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    return out.withColumn("cumulative", F.sum("gain").over(w)).withColumn("cumulative_recall", F.coalesce(F.col("cumulative") / F.col("_g"), F.lit(0.0))).drop("_g")


def redundancy(queries: DataFrame, key: str) -> DataFrame:
    """Share of a trace's queries that repeat one, letter case and white space aside."""
    n = F.count("*")
    return queries.groupBy(key).agg(n.alias("n"), F.when(n <= 1, 0.0).otherwise((n - F.count_distinct(F.lower(X.squeeze(F.col("query"))))) / n).alias("redundancy"))


def failure(answerable: Column, refused: Column, correct: Column, indexed: Column, gold_seen: Column) -> Column:
    """Where an outcome went wrong; the first test that holds."""
    return (
        F.when(~answerable, F.when(refused, "none").otherwise("refusal")).when(refused, "refusal").when(correct, "none").when(~indexed, "extraction").when(~gold_seen, "retrieval").otherwise("synthesis")
    )


def distribution(labelled: DataFrame) -> DataFrame:
    """label, n for every kind of failure, also those that never occur."""
    spark = labelled.sparkSession
    return spark.createDataFrame([(x,) for x in FAILURES], "label string").join(labelled.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def gate(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, delta, verdict: gated figures against a baseline. A configuration that the baseline lacks is a regression."""
    long = lambda df, name: df.unpivot(keys, GATED, "metric", name)
    out = long(now, "value").join(long(before, "baseline"), [*keys, "metric"], "left").withColumn("delta", F.round(F.col("value") - F.col("baseline"), 9))
    verdict = F.when(F.col("baseline").isNull() | (F.col("delta") < -TOLERANCE), "regression").when(F.col("delta") > TOLERANCE, "gain").otherwise("same")
    return out.withColumn("verdict", verdict)


def usage_summary(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, cost, latency, hit rate and fallbacks. usage: tokens_in, tokens_out, cost_usd, latency_ms, cached, fallback."""
    n = F.count("*")
    return usage.groupBy(*keys).agg(n.alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col("cost_usd"))).alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"), (F.count_if("cached") / n).alias("hit_rate"), F.count_if("fallback").alias("fallbacks"))


def cache_stats(calls: DataFrame) -> DataFrame:
    n = F.count("*")
    return calls.agg(F.count_distinct("key").alias("entries"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.when(n > 0, F.count_if("hit") / n).otherwise(0.0).alias("hit_rate"))


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests answered from the cache, distinct requests that are not in it)."""
    latest = cache.groupBy("key").agg(F.max_by("value", "created_at").alias("value"))
    return requests.join(latest, "key"), requests.join(latest, "key", "left_anti").dropDuplicates(["key"])


def latest_steps(records: DataFrame) -> DataFrame:
    """The last record of each (trace, step), by write number."""
    w = Window.partitionBy("trace", "step").orderBy(F.desc("written"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def histogram(value: Column, edges: list[float]) -> Column:
    """The number of the bin of a value: 0 below the first edge."""
    out = F.lit(len(edges))
    for n, e in reversed(list(enumerate(edges))):
        out = F.when(value < e, n).otherwise(out)
    return out


def review_summary(reviews: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean of 0-3 scores, completeness, and how many reviews are repeated or of unknown items."""
    known = reviews.join(expected.select("item_id", F.lit(True).alias("_k")).distinct(), "item_id", "left")
    n = expected.select("item_id").distinct().count()
    return known.agg(F.avg(F.when(F.col("_k"), F.col("score"))).alias("mean"), (F.count_distinct(F.when(F.col("_k"), F.col("item_id"))) / F.lit(max(n, 1))).alias("complete"), (F.count("*") - F.count_distinct("item_id")).alias("repeated"), F.count_if(F.col("_k").isNull()).alias("unknown"))


def recent(traces: DataFrame, n: int, at: str = "created_at", key: str = "trace") -> DataFrame:
    """The newest traces, newest first."""
    return traces.orderBy(F.desc(at), F.col(key)).limit(n)


def novelty(steps: DataFrame) -> DataFrame:
    """trace, step, found, new_docs, seen: how many documents each step gave, and how many of them no earlier step had. steps: trace, step, doc_id."""
    first = steps.groupBy("trace", "doc_id").agg(F.min("step").alias("step")).groupBy("trace", "step").agg(F.count("*").alias("new_docs"))
    found = steps.groupBy("trace", "step").agg(F.count_distinct("doc_id").alias("found"))
    w = Window.partitionBy("trace").orderBy("step")
    return found.join(first, ["trace", "step"], "left").withColumn("new_docs", F.coalesce("new_docs", F.lit(0))).withColumn("seen", F.sum("new_docs").over(w))


def append_steps(written: DataFrame, new: DataFrame) -> DataFrame:
    """Trace records (trace, step, ...) with the new ones behind them: each trace's writes are numbered on, in the order of ``at``."""
    last = written.groupBy("trace").agg(F.max("written").alias("_last"))
    number = F.row_number().over(Window.partitionBy("trace").orderBy("at"))
    more = new.join(last, "trace", "left").withColumn("written", F.coalesce("_last", F.lit(0)) + number).drop("_last")
    return written.unionByName(more.select(*written.columns))


def get_or_set(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(each request with its value and whether it was in the cache, the cache with what was computed). compute: from misses to (key, value, created_at)."""
    hits, misses = cache_split(requests, cache)
    made = store.stored(compute(misses).select(*cache.columns), "computed")
    answered = hits.withColumn("hit", F.lit(True)).unionByName(requests.join(made.select("key", "value"), "key").withColumn("hit", F.lit(False)))
    return answered, cache.unionByName(made)
