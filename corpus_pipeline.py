"""The corpus pipeline: language, near-duplicates, benchmark passages, mixture, tokens in training order.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of docs, whatever these are. Every stage works on all rows that the one before kept.

Defined cases: a row is carried whole beside what a stage computes, so extra columns may have any name. Null, empty and letterless
texts are rejected by the first stage; rows of one id are rows of their own, and a null id is a value like any other: near-duplicates
are told by text, one row of each group stays, null ids last. Very long texts are handled as each operator states; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import decontaminate, langid, mixing, near, tokens
from veritide.llm.common import fold, materialise, table


#: The least score at which a language found stands against the one that a document names.
SURE = 0.8


def _whole(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns that an operator reads, beside the whole row as one column that nothing can clash with."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told and is the one they name, if any.

    Rejected: no letters at all, or another language than ``lang`` says, found with a score of ``SURE`` at least. Half of the
    ids teach what judges the other half, so no document's own ``lang`` speaks for it.
    """
    half, found = fold("doc_id", 2), []
    for k in (0, 1):
        parser = langid.learn(docs.where(half != k))
        if not parser.languages:
            parser = langid.learn(docs)
        found.append(langid.identify(_whole(docs.where(half == k), "text", F.col("lang").alias("_says")), parser))
    judged = found[0].unionByName(found[1])
    other = F.coalesce((F.col("lang_pred") != F.col("_says")) & (F.col("score") >= SURE), F.lit(False))
    return judged.where((F.col("lang_pred") != "und") & ~other).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Linked: five-word Jaccard similarity of 0.8 at least, compared exactly, of candidates by SimHash and by MinHash bands."""
    return near.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    marked = decontaminate.decontaminate(_whole(docs, "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.where("not contaminated").select("_doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    mixed = mixing.mix(_whole(docs, "doc_id", "text", "source"))
    return mixed.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training order, written to shards."""
    return tokens.to_shards(docs)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("token_output", token_output),
]

#: Hashes decide mixture and order, which SQL cannot follow; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
