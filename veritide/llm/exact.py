"""Exact duplicates. DataFrame functions only.

1. A 128-bit hash of each row's content; rows of one hash are counted and the first of them found, from slim stored rows.
2. Bytes are compared within hashes that several rows share: their distinct contents are counted, combined in each task before
   they move, so a text with many copies moves once a task. Are there few such hashes, they are broadcast and no other text
   moves; are there more than ``BROADCAST``, all texts are looked at the same way.
3. Should two contents have one hash, their rows are grouped by the contents themselves. No hash but of equal bytes makes copies.
4. Rows learn of their group in a join with groups of two rows or more; any other row is a group of its own. A hash with very many
   rows is one row on the other side of that join, and Spark splits its rows over tasks.

Of copies the row with the longest text stays (in code points), then the smallest id, null last; of rows alike in both, one.

Defined cases: a null text counts as empty, and empty texts equal blank ones; long texts are hashed and compared whole; a null id
is no id's equal and is kept only where no other row is as long; rows repeated whole are copies of each other, one of which is kept;
an empty table gives no rows. Extra columns may have any name and are kept (own columns replace any of the same name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, carry, materialise, quoted

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: The most shared hashes, of 16 bytes each, that are sent to all tasks.
BROADCAST = 1 << 19


def digest(content: Column) -> Column:
    """128 bits of a content."""
    return F.unhex(F.md5(content))


def normal(text: Column) -> Column:
    """A text without its white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def groups(rows: DataFrame, hashed: Callable[[Column], Column] = digest, broadcast: int = BROADCAST) -> DataFrame:
    """rows (own, order, content) to (own, order, n, first): the rows of equal content and the least order of them; both null for a content without copies.

    order tells rows apart (``place``), own is what a row carries.
    """
    h = hashed(F.col("content"))
    slim = materialise(rows.select("own", "order", h.alias("h")), "hashes")
    shared = materialise(slim.groupBy("h").agg(F.count("*").alias("n"), F.min("order").alias("first")).where("n > 1"), "shared")
    texts = rows.select(h.alias("h"), "content")
    if shared.count() <= broadcast:
        texts = texts.join(F.broadcast(shared.select("h")), "h", "left_semi")
    clash = materialise(texts.distinct().groupBy("h").count().where("count > 1").select("h"), "clash")
    if clash.isEmpty():
        return slim.join(shared, "h", "left").select("own", "order", "n", "first")
    #: Their rows are stored with the contents, so that places stay what they are.
    met = materialise(rows.withColumn("h", h).join(clash, "h", "left_semi"), "clashing")
    told = met.groupBy("h", "content").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    apart = met.join(told, ["h", "content"]).select("own", "order", "n", "first")
    alone = slim.join(clash, "h", "left_anti").join(shared, "h", "left").select("own", "order", "n", "first")
    return alone.unionByName(apart)


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashed: Callable[[Column], Column] = digest, broadcast: int = BROADCAST) -> DataFrame:
    """docs without the text, with keep_id (the id of the row that stays), group_size, kept and text_sha256 of the text without white space."""
    given, content = F.col(quoted(text)), normal(F.col(quoted(text)))
    own = F.struct(carry(docs, {text, *ADDED}).alias("row"), F.col(quoted(doc_id)).alias("id"), F.sha2(content, 256).alias("sha"))
    longest = -F.length(F.coalesce(given, F.lit("")))
    order = F.struct(longest.alias("longest"), F.col(quoted(doc_id)).isNull().alias("none"), F.col(quoted(doc_id)).alias("id"), F.monotonically_increasing_id().alias("place"))
    found = groups(docs.select(own.alias("own"), order.alias("order"), content.alias("content")), hashed, broadcast)
    alone = F.col("n").isNull()
    return found.select(
        "own.row.*",
        F.when(alone, F.col("own.id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("order.place") == F.col("first.place"), alone).alias("kept"),
        F.col("own.sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, whole, with the one row of each group that stays."""
    whole = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(doc_id)).alias("id"), carry(docs).alias("whole"))
    return mark(whole, "text", "id").where("kept").select("whole.*")
