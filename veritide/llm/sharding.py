"""Sharding by extendible hashing. DataFrame functions only.

A document's hash is the first 60 bits of an MD5 over its id and text. The directory is indexed by leading bits: a bucket is all
documents that share its bits, and only a bucket above the byte limit splits on one bit more, until every shard fits. As a
bucket's bytes never grow when it splits, a document's shard is its shortest prefix whose bytes fit: one histogram of prefixes a
few bits deeper than an even spread would need gives all depths at once, and only cells that are too large even there are
looked at again, some bits deeper. No level reads the texts again.

What no bit can part (rows equal in id and text) is dealt to numbered overflow shards; one row above the limit is a shard of its own.

Defined cases: a null or empty text has 0 bytes; a very long text counts by its bytes like any other; a null id is a value of its
own; ties do not arise, as a shard is a bucket; an empty table gives no shards. Extra columns are kept (own columns replace any of
the same name).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shielded

LIMIT, BITS, DEEPER, FIRST_MOST = 1 << 20, 60, 4, 22
ADDED = ("bytes", "shard", "depth", "shard_bytes", "shard_rows")


def hashed(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("\u0001")), F.lit("\u0000"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    """The first bits of a hash; of depth 0 there is one prefix."""
    return F.shiftright(h, BITS - depth)


def bits(p: Column, depth: Column) -> Column:
    """A prefix as a string of 0 and 1; the root is empty."""
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(p), depth, "0"))


def split(cells: DataFrame, limit: int, low: int, deep: int) -> DataFrame:
    """cells (cell: prefixes of ``deep`` bits, b, n) with the depth, from ``low`` on, at which their bucket fits: cell, depth, shard_bytes, shard_rows; no row for those above the limit even at ``deep``."""

    def levels(least: int) -> DataFrame:
        return cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(least), F.lit(deep))).alias("d")).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("d")).cast("int")))

    sums = levels(low).groupBy("d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = materialise(sums.where(F.col("shard_bytes") <= limit), "fits")
    #: Above the first depth at which any bucket fits no cell has its shard, and few buckets hold all cells: these are not joined.
    least = fits.agg(F.min("d")).first()[0]
    met = levels(deep if least is None else least).select("cell", "d", "p").join(fits.hint("merge"), ["d", "p"])
    return met.groupBy("cell").agg(F.min(F.struct("d", "p", "shard_bytes", "shard_rows")).alias("m")).select("cell", F.col("m.d").alias("depth"), bits(F.col("m.p"), F.col("m.d")).alias("shard"), "m.shard_bytes", "m.shard_rows")


def directory(slim: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """(depth of the cells, cell -> shard) for each round, and the hashes that no bit can part (h, b, n) if any. slim: h, b, n."""
    total = slim.agg(F.sum("b")).first()[0] or 0
    low, deep = 0, min(FIRST_MOST, max(0, math.ceil(math.log2(max(1, total / limit)))) + DEEPER)
    rounds = []
    while True:
        cells = materialise(slim.groupBy(prefix(F.col("h"), deep).alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "cells")
        placed = materialise(split(cells, limit, low, deep), "directory")
        rounds.append((deep, placed))
        large = cells.where(F.col("b") > limit).select("cell")
        if large.isEmpty():
            return rounds, None
        slim = materialise(slim.join(large, prefix(F.col("h"), deep) == F.col("cell"), "left_semi"), "oversized")
        if deep == BITS:
            return rounds, slim
        low, deep = deep + 1, min(BITS, deep + 12)


def shard(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with bytes, shard (its bits, and ``+n`` for overflow), depth, shard_bytes, shard_rows."""
    return shielded(docs, {"text": text, "doc_id": doc_id}, ADDED, lambda rows: _sharded(rows, limit))


def _sharded(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    kept = docs.columns
    rows = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), hashed(F.col(doc_id), F.col(text)).alias("_h"))
    slim = materialise(rows.groupBy(F.col("_h").alias("h")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")), "hashes")
    rounds, stuck = directory(slim, limit)
    out = rows
    columns = ("shard", "depth", "shard_bytes", "shard_rows")
    for k, (deep, placed) in enumerate(rounds):
        named = placed.select(F.col("cell").alias(f"_c{k}"), *(F.col(c).alias(f"_{c}{k}") for c in columns))
        #: The directory grows with the documents: a merge join at any size.
        out = out.join(named.hint("merge"), prefix(F.col("_h"), deep) == F.col(f"_c{k}"), "left")
    out = out.select(*kept, "bytes", "_h", *(F.coalesce(*(F.col(f"_{c}{k}") for k in range(len(rounds)))).alias(c) for c in columns))
    if stuck is None:
        return out.drop("_h")
    #: Equal rows: as many to an overflow shard as fit (one at least), counted within stored parts and over the parts in turn.
    some = materialise(out.where("shard IS NULL").withColumn("_part", F.spark_partition_id()), "equalrows")
    parts = some.groupBy("_h", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_h").alias("_ph"), F.col("_part").alias("_pp"), before.alias("_before"), F.sum("_n").over(Window.partitionBy("_h")).alias("_all"))
    number = F.row_number().over(Window.partitionBy("_h", "_part").orderBy(F.lit(1))) - 1
    each = F.greatest(F.lit(1), F.floor(limit / F.col("bytes"))).cast("long")
    dealt = some.withColumn("_number", number).join(parts, (F.col("_h") == F.col("_ph")) & (F.col("_part") == F.col("_pp"))).withColumn("_each", each).withColumn("_k", F.floor((F.col("_number") + F.col("_before")) / F.col("_each")))
    size = F.least(F.col("_each"), F.col("_all") - F.col("_k") * F.col("_each")).cast("long")
    dealt = dealt.select(*kept, "bytes", F.concat(bits(F.col("_h"), F.lit(BITS)), F.lit("+"), F.col("_k").cast("string")).alias("shard"), F.lit(BITS).alias("depth"), (size * F.col("bytes")).alias("shard_bytes"), size.alias("shard_rows"))
    return out.where("shard IS NOT NULL").drop("_h").unionByName(dealt)


def write(docs: DataFrame, path: str, **how) -> None:
    """One folder a shard under path. Rows of a shard go to one task, which the byte limit bounds."""
    sharded = shard(docs, **how)
    sharded.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
