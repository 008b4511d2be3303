"""A sink for streams of traces: several tables, each batch written once however often it is replayed.

A batch's data go to folders of their own; then one ledger entry, named after the batch, says which these are. Entries get their names
in one rename and are never overwritten, so a batch that was written before a crash, or by another driver that is about to die, is
found in the ledger when it comes again and left alone. Readers read what the ledger names: whole batches only. What a crash leaves
behind is named by no entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from veritide.sources import versions

Tables = dict[str, Callable[[DataFrame], DataFrame]]


def write_batch(batch: DataFrame, number: int, root: str, tables: Tables) -> bool:
    """The tables of one batch, unless the ledger has it; whether it was written now. tables: name to what it holds of a batch."""
    spark, root = batch.sparkSession, root.rstrip("/")
    #: The ledger counts batches from 1, a stream from 0.
    if number + 1 in versions.numbers(spark, root):
        return False
    batch.persist()
    try:
        said = {name: versions.put(of(batch), root, name) for name, of in tables.items()}
    finally:
        batch.unpersist()
    try:
        versions.publish(spark, root, number + 1, {"tables": said})
    except versions.Conflict:
        return False
    return True


def into(stream: DataFrame, root: str, tables: Tables, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream; start() it. checkpoint: where Spark keeps which batch comes next."""

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, root, tables)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table, over all batches of the ledger."""
    root = root.rstrip("/")
    folders = [versions.read(spark, root, n)[1]["tables"][name] for n in versions.numbers(spark, root)]
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
