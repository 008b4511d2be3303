"""URL filters by expression expansion, short hash prefixes and full digests. DataFrame functions only.

Each URL is expanded into its host suffixes times its path prefixes, of the numbers of labels and the lengths that rules have. The
expressions meet the rules in an equi-join on the first 32 bits of their SHA-256 alone; what meets is confirmed by the whole
digest, and the longest confirmed rule wins. The rule table is joined by whichever strategy its size allows (Spark broadcasts it
below its own threshold and shuffles both sides beyond it), so a list of many millions of rules needs no other code.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule. A very long URL is expanded as often as a
short one: no more than rules have lengths. Empty tables give no rows, or the default for all. Rows are judged one by one,
so repeated rows give repeated results. Rules with a null host or path never fit; repeated rules count once, and of the
same rule listed with both verdicts, block wins. No rule: ``default``. Extra columns are kept; the operator's own
columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shielded

ADDED = ("host", "path", "rule", "verdict")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: Column, counts: Column) -> Column:
    """The host's last labels, as many as some rule's host has."""
    return F.transform(F.filter(counts, lambda n: n <= F.regexp_count(host, F.lit(r"\.")) + 1), lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def path_prefixes(path: Column, lengths: Column) -> Column:
    """The prefixes of a path at the given lengths: those that some rule's path has."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict (allow or block)."""
    known = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
        .withColumn("rule_text", F.concat("host", "path"))
        .withColumn("digest", F.sha2(F.concat("host", F.lit("\u0000"), "path"), 256))
        .select(F.substring("digest", 1, 8).alias("prefix"), "digest", "rule_text", "rule_verdict", F.length("host").alias("host_length"))
    )
    #: One row: the numbers of labels of the rules' hosts and the lengths of their paths. Hosts and paths bound both, not the number of rules.
    labels = F.regexp_count("host", F.lit(r"\.")) + 1
    lengths = rules.where("host is not null and path is not null").agg(F.array_sort(F.collect_set(labels)).alias("_labels"), F.array_sort(F.collect_set(F.length("path"))).alias("_lengths"))

    def judged(given: DataFrame) -> DataFrame:
        host, path = url_parts(F.col("url"))
        #: Stored, so that rows have numbers that stay theirs.
        rows = materialise(given.select("*", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row")), "pages")
        pairs = F.flatten(F.transform(host_suffixes(F.col("host"), F.col("_labels")), lambda h: F.transform(path_prefixes(F.col("path"), F.col("_lengths")), lambda p: F.sha2(F.concat(h, F.lit("\u0000"), p), 256))))
        slim = rows.where("host <> ''").select("_row", "host", "path").join(F.broadcast(lengths)).select("_row", F.explode(pairs).alias("_full")).withColumn("_prefix", F.substring("_full", 1, 8))
        #: The join key is the prefix alone; a rule that shares it by chance has another digest. Only numbers and rules move, the rest of a row once.
        met = slim.join(known, F.col("_prefix") == F.col("prefix")).where(F.col("_full") == F.col("digest"))
        best = met.groupBy(F.col("_row").alias("_of")).agg(F.max(F.struct(F.length("rule_text").alias("n"), "host_length", "rule_verdict", "rule_text")).alias("_best"))
        out = rows.join(best, F.col("_row") == F.col("_of"), "left")
        return out.withColumn("rule", F.col("_best.rule_text")).withColumn("verdict", F.coalesce(F.col("_best.rule_verdict"), F.lit(default)))

    return shielded(pages, {"url": url}, ADDED, judged)
