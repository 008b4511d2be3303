"""Queries that run streams to their end: events are dealt into files, read as a stream, and what the sink holds is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.plans.registry import ORACLE_SQL, QUERIES, query
from veritide.sources import store
from veritide.streaming import sink, traces

__all__ = ["ORACLE_SQL", "QUERIES"]

CALLS_SQL = """WITH RECURSIVE c AS (SELECT 'b' || user_id % 4 AS backend, epoch_us(ts) // 1000 AS ms, value >= 30 AS ok FROM events), e AS (SELECT max(ms) - 600000 AS w FROM c),
n AS (SELECT backend, ms, ok, row_number() OVER (PARTITION BY backend ORDER BY ms, ok) AS i FROM c, e WHERE ms <= w),
f AS (SELECT DISTINCT backend, 0::bigint AS i, 0 AS failures, NULL::bigint AS opened, NULL::bigint AS half, NULL::bigint AS now FROM n
  UNION ALL SELECT backend, i, CASE WHEN o0 IS NOT NULL THEN f0 WHEN ok THEN 0 ELSE f0 + 1 END, CASE WHEN o0 IS NOT NULL THEN o0 WHEN NOT ok AND f0 >= 4 THEN ms END, half, CASE WHEN o0 IS NULL AND NOT ok AND f0 >= 4 THEN ms END
  FROM (SELECT n.*, CASE WHEN opened + 60000 <= ms THEN 0 ELSE failures END AS f0, CASE WHEN opened + 60000 > ms THEN opened END AS o0, CASE WHEN opened + 60000 <= ms THEN opened + 60000 END AS half FROM f JOIN n ON n.backend = f.backend AND n.i = f.i + 1)),
z AS (SELECT backend, arg_max(coalesce(opened, -1), i) AS opened FROM f GROUP BY backend)
SELECT backend, half AS at_ms, 'half_open' AS became, 0 AS failures FROM f WHERE half IS NOT NULL UNION ALL SELECT backend, now, 'open', 5 FROM f WHERE now IS NOT NULL UNION ALL SELECT backend, opened + 60000, 'half_open', 0 FROM z, e WHERE opened >= 0 AND opened + 60000 <= w"""


def event_stream(v, files: int, at_once: int | None = None) -> DataFrame:
    """Events from so many files in the shared folder, as a stream of so many files a batch."""
    events = v.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = store.written(events.repartition(files), "events")
    reader = v.spark.readStream.schema(events.schema)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(path)


@query(CALLS_SQL)
def breaker_transitions(v):
    """When the breakers of four backends opened and let calls through again, up to the watermark that all events give."""
    v.spark.conf.set(*traces.STORE)
    calls = event_stream(v, 4).select(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("backend"), (F.col("value") >= 30).alias("ok"), "ts")
    out, cp = store.fresh(v.spark, "transitions"), store.fresh(v.spark, "checkpoint")
    tables = {"transitions": lambda b: b.select("backend", F.unix_millis("at").alias("at_ms"), "became", "failures")}
    run = sink.into(traces.breaker_log(calls), out, tables, cp).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return sink.read(v.spark, out, "transitions", "backend string, at_ms long, became string, failures int")


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS calls, round(sum(value), 4) AS total, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def trace_sink(v):
    """Two tables of a stream's batches, each written once: partial usage, and errors."""
    out, cp = store.fresh(v.spark, "traces"), store.fresh(v.spark, "checkpoint")
    bucket = (F.col("user_id") % 10).alias("bucket")
    tables = {"usage": lambda b: b.groupBy("event_type", bucket).agg(F.count("*").alias("calls"), F.sum("value").alias("total")), "errors": lambda b: b.where("event_type = 'error'").select("event_id", bucket)}
    run = sink.into(event_stream(v, 8, 3), out, tables, cp).trigger(availableNow=True).start()
    run.awaitTermination()
    usage = sink.read(v.spark, out, "usage", "event_type string, bucket long, calls long, total double").groupBy("event_type", "bucket").agg(F.sum("calls").alias("calls"), F.round(F.sum("total"), 4).alias("total"))
    errors = sink.read(v.spark, out, "errors", "event_id long, bucket long").groupBy(F.lit("error").alias("event_type"), "bucket").agg(F.count("*").alias("errors"))
    return usage.join(errors, ["event_type", "bucket"], "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
