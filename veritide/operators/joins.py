"""Joins that equality does not say: the latest row before each of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.operators import ordered


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], or_equal: bool = False) -> DataFrame:
    """left with the values of the last row of right with its key and an earlier time (or_equal: or the same), null if there is none.

    Both sides are one table in ranges of key and time; nothing is joined row by row, and a key that holds all rows is spread over
    all ranges, each of which hands its last value on to the next. Of right rows of one time the largest values count. A null key
    or a null time meets nothing.
    """
    own = F.struct(*left.columns)
    theirs = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(*values).alias("_v"))
    theirs = theirs.groupBy("_k", "_t").agg(F.max("_v").alias("_v"))
    #: At one time, rows of the right come first if they count, and last if they do not.
    both = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_o"), own.alias("_l")).unionByName(theirs.withColumn("_o", F.lit(0 if or_equal else 2)), allowMissingColumns=True)
    told = ordered.last_so_far(both, ["_k"], ["_t", "_o"], "_v", "_last").where("_o = 1")
    return told.select("_l.*", *(F.when(F.col("_t").isNotNull(), F.col(f"_last.{c}")).alias(f"last_{c}") for c in values))
