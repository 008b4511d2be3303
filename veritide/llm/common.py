"""What the training-data operators share: the shared folder, intermediate tables and word rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: A word: a run of anything else.
WORD = rf"[^{SPACE}]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own for a local master where it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="veritide-")
    return _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        return


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/veritide-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back.

    Cuts lineage as checkpoint() does, in columnar form: lost executors re-read files and never recompute what is above.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise() wrote and that no plan will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which then gives freed memory back: a worker waits for its next task with no more than it needs."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def carry(docs: DataFrame, without: Iterable[str] = ()) -> Column:
    """The columns of docs, but for some, as one struct: a row travels in it beside an operator's own columns, and no names clash."""
    leave = {c.lower() for c in without}
    return F.struct(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in leave))


def shielded(docs: DataFrame, own: dict[str, str], added: Sequence[str], run: Callable[[DataFrame], DataFrame], drop: Sequence[str] = ()) -> DataFrame:
    """What run gives for docs, whatever other columns docs has: columns of docs but for ``drop``, then ``added``.

    own: the names that run reads, and which column of docs each is. All others travel in one struct, ``_doc``, so that they clash with no
    column of run's; of those named like an added one nothing is kept.
    """
    taken = {c.lower() for c in (*own.values(), *added)}
    rest = [c for c in docs.columns if c.lower() not in taken]
    inner = docs.select(*(F.col(quoted(given)).alias(name) for name, given in own.items()), *([carry(docs, taken).alias("_doc")] if rest else []))
    of = {given.lower(): name for name, given in own.items()}
    kept = [c for c in docs.columns if c not in drop and c.lower() not in {a.lower() for a in added}]
    back = [F.col(of[c.lower()]).alias(c) if c.lower() in of else F.col(f"_doc.{quoted(c)}").alias(c) for c in kept]
    return run(inner).select(*back, *added)


def fold(column: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod. A null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
