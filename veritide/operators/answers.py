"""Answers: which claims their citations bear out, how a packet scores, and what a run has ready."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.operators import evidence


def verify(claims: DataFrame, citations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims that stay, citations that hold). claims: trace_id, claim_id, text, support, citation_ids; citations: trace_id, id, ....

    A claim stays with a citation that holds. It is borne out if its words stand in one and none was lost; then its support
    gives its confidence, else it is inferred.
    """
    good = evidence.check_citations(citations, chunks).where("problem IS NULL").drop("problem")
    each = claims.select("trace_id", "claim_id", "text", F.explode("citation_ids").alias("id")).join(good.select("trace_id", "id", "excerpt"), ["trace_id", "id"])
    held = each.groupBy("trace_id", "claim_id").agg(F.array_sort(F.collect_set("id")).alias("held"), F.bool_or(F.contains("excerpt", "text")).alias("entailed"))
    out = claims.join(held, ["trace_id", "claim_id"])
    sure = F.col("entailed") & (F.size("held") == F.size(F.array_distinct("citation_ids")))
    support = F.when(sure, F.col("support")).otherwise("inferred")
    kept = out.select("trace_id", "claim_id", "text", support.alias("support"), F.col("held").alias("citation_ids"), evidence.confidence(support).alias("confidence"))
    used = kept.select("trace_id", F.explode("citation_ids").alias("id")).distinct()
    return kept, good.join(used, ["trace_id", "id"], "left_semi")


def valid_box(box: Column, width: Column, height: Column) -> Column:
    """Whether four numbers are a box within a page; unknown page sizes give no box."""
    at = lambda k: F.get(box, F.lit(k))
    return F.coalesce((F.size(box) == 4) & (at(0) >= 0) & (at(1) >= 0) & (at(0) < at(2)) & (at(1) < at(3)) & (at(2) <= width) & (at(3) <= height), F.lit(False))


def structural_errors(unresolved: Column, hash_mismatch: Column, unknown_marker: Column, partial_unexplained: Column) -> Column:
    """The names of a packet's faults, in this order."""
    return F.array_compact(F.array(F.when(unresolved, "claim_citation_unresolved"), F.when(hash_mismatch, "citation_hash_mismatch"), F.when(unknown_marker, "figure_marker_unresolved"), F.when(partial_unexplained, "partial_without_missing_information")))


def whole_match(text: Column, accepted: Column) -> Column:
    """Whether an accepted form stands in a text as whole words: 94 is not in 194."""
    norm = lambda c: X.squeeze(F.translate(F.regexp_replace(F.lower(X.fold_quotes(c)), ",", ""), "-", " "))
    pad = lambda c: F.concat(F.lit(" "), F.regexp_replace(norm(c), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    return F.exists(F.filter(accepted, lambda a: F.trim(a) != ""), lambda a: F.contains(pad(text), pad(a)))


def score_assets(assets: DataFrame) -> DataFrame:
    """assets (subject, values, question, claim) with score: 0 unless both name the subject; more if it has values."""
    pad = lambda c: F.concat(F.lit(" "), X.words(F.col(c)), F.lit(" "))
    name = F.regexp_replace(X.words(F.col("subject")), "^the ", "")
    both = (F.length(name) >= 3) & F.contains(pad("question"), F.concat(F.lit(" "), name, F.lit(" "))) & F.contains(pad("claim"), F.concat(F.lit(" "), name, F.lit(" ")))
    return assets.withColumn("score", F.when(~both, 0.0).when(F.size("values") > 0, 0.95).otherwise(0.85))


def covered(questions: DataFrame, quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """trace_id, sufficient, missing: sub-questions without a verbatim quote in a known chunk. quotes: trace_id, sub_question, chunk_id, quote."""
    ok = quotes.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id").where(F.contains("_t", "quote")).select("trace_id", "sub_question").distinct().withColumn("_ok", F.lit(True))
    all_ = questions.select("trace_id", "sub_question").distinct().join(ok, ["trace_id", "sub_question"], "left")
    return all_.groupBy("trace_id").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("sufficient"), F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("sub_question")))).alias("missing"))


def readiness(counts: DataFrame) -> DataFrame:
    """counts (documents, chunks, images, vectors, providers) with status and what is missing."""
    c = F.col
    status = F.when((c("chunks") > 0) & (c("providers") > 0) & (c("vectors") > 0), "ready").when((c("documents") > 0) | (c("chunks") > 0) | (c("images") > 0), "degraded").otherwise("not_ready")
    detail = F.array_compact(F.array(F.when(c("providers") == 0, "no provider configured"), F.when(c("chunks") == 0, "no chunks indexed"), F.when(c("vectors") == 0, "vector table is empty").when(c("vectors") < 0, "vector table cannot be read"), F.when(c("images") == 0, "no images described")))
    return counts.withColumn("status", status).withColumn("detail", detail)


def recovery(records: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, by_ocr, by_model: which channel's text holds an accepted answer. records: asset_id, ocr_text, model_text; gold: qid, asset_id, accept."""
    norm = lambda c: F.trim(F.translate(F.regexp_replace(F.lower(c), ",", ""), "-", " "))
    hit = lambda t: F.exists("accept", lambda a: F.contains(norm(F.coalesce(F.col(t), F.lit(""))), norm(a)))
    return gold.join(records, "asset_id").select("qid", hit("ocr_text").alias("by_ocr"), hit("model_text").alias("by_model"))


@dataclass(frozen=True)
class Retry:
    """Doubling delays with jitter, for calls that leave Spark."""

    attempts: int = 5
    base: float = 1.0
    most: float = 30.0
    jitter: float = 0.25

    def delay(self, attempt: int, asked: float | None = None) -> float:
        d = asked if asked is not None else min(self.base * 2 ** (attempt - 1), self.most)
        return d + random.uniform(0, self.jitter * d)

    def run(self, call: Callable, retryable: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
        for attempt in range(1, self.attempts + 1):
            try:
                return call()
            except retryable as e:
                if attempt == self.attempts:
                    raise
                sleep(self.delay(attempt, getattr(e, "retry_after", None)))
        raise AssertionError
