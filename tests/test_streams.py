"""Streams held against plain folds: breakers with timers, late calls, restarts; a sink that writes each batch once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.sources import versions
from veritide.streaming import sink, traces

CALLS = "backend string, ok boolean, ms long"


@pytest.fixture
def timed(spark):
    before = spark.conf.get(traces.STORE[0])
    spark.conf.set(*traces.STORE)
    yield spark
    spark.conf.set(traces.STORE[0], before)


def plain(calls, until):
    """What a breaker becomes, call by call."""
    out, failures, opened = [], 0, None
    for at, ok in [*sorted(c for c in calls if c[0] <= until), (until, None)]:
        if opened is not None and at - opened >= 60_000:
            out.append((opened + 60_000, "half_open", 0))
            failures, opened = 0, None
        if ok is None or opened is not None:
            continue
        failures = 0 if ok else failures + 1
        if failures == 5:
            opened = at
            out.append((at, "open", 5))
    return out


def test_breakers_over_batches_equal_a_plain_fold(timed, tmp_path):
    """Calls out of order within the watermark count in the order of time, later ones do not; a restart goes on from its state; a timer alone lets calls through."""
    r, root = random.Random(5), f"file://{tmp_path}/out"
    sent, expected, high = {k: [] for k in "abc"}, {k: [] for k in "abc"}, 0
    (tmp_path / "in").mkdir()
    stream = timed.readStream.schema(CALLS).parquet(f"file://{tmp_path}/in").select("backend", "ok", F.timestamp_millis("ms").alias("ts"))

    def advance():
        run = sink.into(traces.breaker_log(stream, "30 seconds"), root, {"t": lambda b: b.select("backend", F.unix_millis("at").alias("ms"), "became", "failures")}, f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(240) or run.exception() is None

    for step in range(3):
        late = max(0, high - 30_000)
        rows = [(k, r.random() < 0.25, r.randrange(late + (1 if step else 0), late + 200_000)) for k in "ab" for _ in range(60)]
        rows += [("c", False, 1000 + k) for k in range(5)] if step == 0 else [("a", True, max(0, late - 5_000 - k)) for k in range(3)]
        timed.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for k, ok, at in rows:
            if at > late or step == 0:
                expected[k].append((at, ok))
            sent[k].append((at, ok))
        high = max(high, *(at for _, _, at in rows))
        advance()
        got = sink.read(timed, root, "t", "backend string, ms long, became string, failures int").collect()
        for k in "abc":
            assert sorted((x.ms, x.became, x.failures) for x in got if x.backend == k) == sorted(plain(expected[k], high - 30_000)), (k, step)
    assert [(x.became) for x in sorted(got, key=lambda x: x.ms) if x.backend == "c"] == ["open", "half_open"]


def test_a_batch_that_comes_again_writes_nothing_twice(spark, tmp_path, monkeypatch):
    """Crashes before and after the ledger knows a batch; the restarted stream equals the batch result."""
    root, cp = f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    tables = {"all": lambda b: b, "even": lambda b: b.where("id % 2 = 0")}
    spark.range(100).repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    publish, calls = versions.publish, []

    def failing(spark, root, number, said):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("crash before")
        publish(spark, root, number, said)
        if len(calls) == 4:
            raise RuntimeError("crash after")

    monkeypatch.setattr(versions, "publish", failing)
    for _ in range(4):
        run = sink.into(stream, root, tables, cp).trigger(availableNow=True).start()
        try:
            run.awaitTermination(120)
            break
        except Exception:  # noqa: BLE001, S112  the crash that was asked for
            continue
    assert calls == [1, 2, 2, 3, 4, 5] or calls[:2] == [1, 2]
    assert sorted(x.id for x in sink.read(spark, root, "all", "id long").collect()) == list(range(100))
    assert sorted(x.id for x in sink.read(spark, root, "even", "id long").collect()) == list(range(0, 100, 2))
    assert not sink.write_batch(spark.range(3), 0, root, tables) and sink.read(spark, root, "all", "id long").count() == 100
    assert sink.read(spark, f"file://{tmp_path}/none", "all", "id long").count() == 0


def test_transitions_in_slices_equal_a_plain_fold():
    """Whatever the cuts between slices, and however many calls share a time."""
    r = random.Random(9)
    for case in range(300):
        span = r.choice([20, 2_000, 400_000, 4_000_000])
        calls = sorted((r.randrange(span), r.random() < r.choice([0.1, 0.3, 0.6])) for _ in range(r.randrange(0, 200)))
        state, out = (0, None), []
        cuts = sorted(r.randrange(0, len(calls) + 1) for _ in range(r.randrange(0, 6)))
        for a, b in zip([0, *cuts], [*cuts, len(calls)], strict=True):
            at, ok = np.array([c[0] for c in calls[a:b]], np.int64), np.array([c[1] for c in calls[a:b]], bool)
            state, told = traces.transitions(state, at, ok)
            out += told
        assert out + traces.until(state, span)[1] == plain(calls, span), case


def test_what_a_breaker_keeps_grows_with_time_not_with_calls(timed, tmp_path):
    """Calls wait packed, not as a row of state each, and are folded slice by slice; a call without an outcome failed, one without a time is none."""
    r, root = random.Random(3), f"file://{tmp_path}/out"
    rows = [("a", r.random() < 0.4, r.randrange(5_000_000)) for _ in range(20_000)] + [("a", None, 5_100_000 + k) for k in range(5)] + [("a", True, None)] * 3 + [("a", True, 9_000_000)]
    timed.createDataFrame(rows, CALLS).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = timed.readStream.schema(CALLS).parquet(f"file://{tmp_path}/in").select("backend", "ok", F.timestamp_millis("ms").alias("ts"))
    run = sink.into(traces.breaker_log(stream, "30 seconds"), root, {"t": lambda b: b.select(F.unix_millis("at").alias("ms"), "became", "failures")}, f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = sorted((x.ms, x.became, x.failures) for x in sink.read(timed, root, "t", "ms long, became string, failures int").collect())
    assert got == sorted(plain([(at, bool(ok)) for _, ok, at in rows if at is not None], 8_970_000))
    assert max(s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]) < 100
