"""Tables of the library's own: written once to the folder that all executors share, read by every plan that needs them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: dict[tuple[str, str], dict[str, str]] = {}
#: What passing() will delete, the innermost last; None: what is stored now stays.
_passing: list[list[str] | None] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own for a local master where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veritide-")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        return


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there lives as long as the process."""
    path = f"{shared_dir(spark)}/veritide-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    if _passing and _passing[-1] is not None:
        _passing[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at its end, but for those of once() and those with a path of their own. No plan may read them later."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield
    finally:
        _passing.pop()
        for path in own:
            _delete(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> str:
    """The path of a table written from df; without a path of its own it lives as long as the process."""
    path = path or fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once. Cuts lineage as checkpoint() does, in columnar form."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def once(spark: SparkSession, key: str, make: Callable[[], dict[str, DataFrame | str]]) -> dict[str, DataFrame]:
    """The tables that make() gives (frames, or paths of what is written already), written at the first call in an application and read at every other."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _kept:
        _passing.append(None)
        try:
            _kept[at] = {name: df if isinstance(df, str) else written(df, name) for name, df in make().items()}
        finally:
            _passing.pop()
    return {name: spark.read.parquet(path) for name, path in _kept[at].items()}
