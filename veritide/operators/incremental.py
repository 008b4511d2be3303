"""An index that takes changes: segments that are never rewritten, ids that are struck out, merges of segments of like size.

A root holds versions (``sources.versions``). A version lists segments in the order in which they came; each has the tables of an index over its own
chunks, and ``struck``, the ids that a change replaced or deleted in the segments before it. A row of a segment lives unless a
later segment strikes its id out. Counts need not look at rows: a segment's ``terms`` and totals hold what its chunks add less what those
struck out took away, so over all segments they add up to those of an index built anew.

A change reads the postings once to find what it strikes out, and writes what it brings; what stays is not rewritten. merge() puts ``FAN``
segments of like size together, so each row is rewritten as often as the logarithm of the table, and a search reads few segments.

One writer at a time: a change made from a version that another has followed up fails as a Conflict. Readers keep the version they
opened, as long as it is one of the last two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.operators import retrieval
from veritide.sources import store, versions

#: Segments of like size that are merged into one.
FAN = 4
TABLES = ("chunks", "postings", "terms", "struck")


@dataclass(frozen=True)
class State:
    """A version as read: its number and, oldest first, its segments: folders of ``TABLES``, rows, and the change in n and tokens that each brings."""

    root: str
    number: int
    segments: list[dict]


def state(spark: SparkSession, root: str) -> State:
    number, said = versions.read(spark, root.rstrip("/"))
    return State(root.rstrip("/"), number, said.get("segments", []))


def _table(spark: SparkSession, at: State, segment: dict, name: str) -> DataFrame:
    return spark.read.parquet(f"{at.root}/{segment[name]}")


def _live(spark: SparkSession, at: State, name: str, among: list[int] | None = None) -> DataFrame | None:
    """The living rows of a table by chunk_id, of all segments or of some."""
    out = None
    for k, segment in enumerate(at.segments):
        if among is not None and k not in among:
            continue
        rows = _table(spark, at, segment, name).withColumn("_seg", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return None
    last = None
    for k, segment in enumerate(at.segments):
        if segment["strikes"]:
            ids = _table(spark, at, segment, "struck").select(F.col("chunk_id").alias("_gone"), F.lit(k).alias("_by"))
            last = ids if last is None else last.unionByName(ids)
    if last is None:
        return out.drop("_seg")
    latest = last.groupBy("_gone").agg(F.max("_by").alias("_by"))
    return out.join(latest, (F.col("chunk_id") == F.col("_gone")) & (F.col("_seg") < F.col("_by")), "left_anti").drop("_seg")


def _put(chunks: DataFrame, at: State) -> tuple[str, DataFrame]:
    """Chunks in a folder of the root, where all else reads them: what is large is written once."""
    folder = versions.put(chunks, at.root, "chunks")
    return folder, chunks.sparkSession.read.schema(chunks.schema).parquet(f"{at.root}/{folder}")


def _segment(spark: SparkSession, at: State, folder: str, chunks: DataFrame, ids: DataFrame) -> dict:
    """A segment of the chunks in a folder that strikes out those of these ids that live."""
    own = versions.fresh("postings")
    made = retrieval.index_tables(chunks, f"{at.root}/{own}")
    postings = spark.read.parquet(made["postings"])
    lengths = F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")
    rows, tokens = postings.select("chunk_id", "dl").distinct().agg(*lengths).first()
    added = made["terms"]
    before, struck, n, strikes = _live(spark, at, "postings"), ids.limit(0), rows, 0
    if before is not None:
        gone = store.stored(before.join(ids, "chunk_id", "left_semi"), "struck")
        struck = gone.select("chunk_id").distinct()
        strikes, less_tokens = gone.select("chunk_id", "dl").distinct().agg(*lengths).first()
        n, tokens = rows - strikes, tokens - less_tokens
        less = gone.where("term IS NOT NULL").groupBy("term").agg((-F.count("*")).alias("df"))
        added = added.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    put = lambda df, name: versions.put(df, at.root, name)
    return {"chunks": folder, "postings": own, "terms": put(added, "terms"), "struck": put(struck, "struck"), "rows": rows, "strikes": strikes, "n": n, "tokens": tokens}


def _publish(spark: SparkSession, at: State, segments: list[dict]) -> State:
    versions.publish(spark, at.root, at.number + 1, {"segments": segments})
    versions.vacuum(spark, at.root)
    return State(at.root, at.number + 1, segments)


def upsert(chunks: DataFrame, root: str) -> State:
    """Chunks (chunk_id, chunk_pos, text, and any others, such as embedding) in place of those of the same ids, and beside all others. Ids stand once each."""
    spark = chunks.sparkSession
    at = state(spark, root)
    folder, chunks = _put(chunks, at)
    if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
        raise ValueError("an id stands twice among the chunks of one change")
    #: Stored apart from texts, so that they are known to be small, and postings need not move to meet them.
    ids = store.stored(chunks.select("chunk_id"), "ids")
    return _publish(spark, at, [*at.segments, _segment(spark, at, folder, chunks, ids)])


def delete(ids: DataFrame, root: str) -> State:
    """Strikes ids (chunk_id) out; unknown ones are no error."""
    spark = ids.sparkSession
    at = state(spark, root)
    if not at.segments:
        return at
    none = _put(_table(spark, at, at.segments[-1], "chunks").limit(0), at)
    return _publish(spark, at, [*at.segments, _segment(spark, at, *none, store.stored(ids.select("chunk_id").distinct(), "ids"))])


def due(segments: list[dict]) -> list[int] | None:
    """The last ``FAN`` neighbouring segments of which none outweighs the others, if there are such.

    Only neighbours merge, for their order says what strikes what. A row that is rewritten comes to a segment of twice its own's size at least.
    """
    for end in range(len(segments), FAN - 1, -1):
        rows = [s["rows"] for s in segments[end - FAN : end]]
        if 2 * max(rows) <= sum(rows):
            return list(range(end - FAN, end))
    return None


def merge(spark: SparkSession, root: str, everything: bool = False) -> State:
    """Merges until no ``FAN`` neighbours are of like size, or all segments into one. A merged segment holds living rows alone.

    The counts of the merged add up as they stand; so does what they strike out in segments before them.
    """
    at = state(spark, root)
    while (run := list(range(len(at.segments))) if everything and len(at.segments) > 1 else due(at.segments)) is not None:
        own = [at.segments[k] for k in run]
        folder, chunks = _put(_live(spark, at, "chunks", run), at)
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        postings = _live(spark, at, "postings", run).repartitionByRange(ranges, "term", "chunk_id").sortWithinPartitions("term")
        all_ = lambda name: [_table(spark, at, s, name) for s in own]  # noqa: B023, E731
        terms, struck = all_("terms"), all_("struck")
        for t, s in zip(terms[1:], struck[1:], strict=True):
            terms[0], struck[0] = terms[0].unionByName(t), struck[0].unionByName(s)
        #: Ids struck out in segments that stay; the first segment of all has none before it.
        left = struck[0].distinct() if run[0] else struck[0].limit(0)
        left = store.stored(left, "struck")
        put = lambda df, name: versions.put(df, at.root, name)  # noqa: B023, E731
        one = {
            "chunks": folder, "postings": put(postings, "postings"), "terms": put(terms[0].groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "terms"), "struck": put(left, "struck"),
            "rows": chunks.count(), "strikes": left.count(), "n": sum(s["n"] for s in own), "tokens": sum(s["tokens"] for s in own),
        }
        at = _publish(spark, at, [*at.segments[: run[0]], one, *at.segments[run[-1] + 1 :]])
    return at


def opened(spark: SparkSession, root: str) -> retrieval.Index:
    """The current version as an index that every search reads."""
    at = state(spark, root)
    if not at.segments:
        raise FileNotFoundError(f"{root} holds no segments")
    chunks, terms = _live(spark, at, "chunks"), None
    for segment in at.segments:
        own = _table(spark, at, segment, "terms")
        terms = own if terms is None else terms.unionByName(own)
    n, tokens = sum(s["n"] for s in at.segments), sum(s["tokens"] for s in at.segments)
    totals = spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
    return retrieval.Index(chunks, chunks.drop("text"), _live(spark, at, "postings"), terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), totals)


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """The living vectors, for dense search; chunks without one are left out."""
    return _live(spark, state(spark, root), "chunks").where("embedding IS NOT NULL")
