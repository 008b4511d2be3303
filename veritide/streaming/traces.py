"""Traces and usage as streams, and a circuit breaker a backend. An extension: batch sources give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Fixed: failures in a row that open a breaker, and seconds until it lets one call try again.
THRESHOLD, RESET = 5, 60
#: The setting that names the provider of state stores, and one that has timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Calls, sum and largest value a window and key. On a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("calls"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("window_start"), key, "calls", "total", "most")


def latest_once(records: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once, its first record within the watermark."""
    rows = records.withWatermark("ts", late) if records.isStreaming else records
    return rows.dropDuplicatesWithinWatermark(keys) if records.isStreaming else rows.dropDuplicates(keys)


TRANSITIONS = "backend string, at long, became string, failures int"


def transitions(state: tuple[int, int | None], at: np.ndarray, ok: np.ndarray) -> tuple[tuple[int, int | None], list[tuple[int, str, int]]]:
    """((failures, opened at), [(at, what a breaker became, failures)]) after calls in the order of time. Times in milliseconds.

    THRESHOLD failures in a row open it. While it is open nothing is tried, so a call in the log changes nothing; RESET seconds later it lets calls
    through again and counts from 0. Steps go from opening to opening, not from call to call.
    """
    (failures, opened), out, n, start = state, [], len(at), 0
    passed = np.maximum.accumulate(np.where(ok, np.arange(n), -1))
    #: Calls that end THRESHOLD failures in a row; THRESHOLD calls after a start these all lie after it.
    full, passes = np.flatnonzero(np.arange(n) - passed >= THRESHOLD), np.flatnonzero(ok)
    while True:
        if opened is not None:
            start = int(np.searchsorted(at, opened + RESET * 1000))
            if start == n:
                break
            out.append((opened + RESET * 1000, "half_open", 0))
            failures, opened = 0, None
        k = int(np.searchsorted(passes, start))
        lead = (int(passes[k]) if k < len(passes) else n) - start
        if failures + lead >= THRESHOLD:
            last = start + THRESHOLD - failures - 1
        elif (k := int(np.searchsorted(full, start + THRESHOLD - 1))) < len(full):
            last = int(full[k])
        else:
            failures = failures + lead if lead == n - start else n - 1 - int(passed[-1])
            break
        failures, opened = THRESHOLD, int(at[last])
        out.append((opened, "open", failures))
    return (failures, opened), out


def until(state: tuple[int, int | None], now: int) -> tuple[tuple[int, int | None], list[tuple[int, str, int]]]:
    """What a breaker becomes by a time without calls."""
    if state[1] is not None and now - state[1] >= RESET * 1000:
        return (0, None), [(state[1] + RESET * 1000, "half_open", 0)]
    return state, []


#: Calls packed at once, and the milliseconds of one slice of what waits: a breaker folds one slice after the other.
PACKED, SLICE = 1 << 20, 3_600_000
CALL = np.dtype([("at", "<i8"), ("ok", "?")])


class _Breaker(StatefulProcessor):
    """Keeps a backend's calls until the watermark has passed them, packed by slices of time, and folds them in the order of time. One timer a backend: its next call, or the time at which it opens again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures int, opened long, packs long")
        self.waiting = handle.getMapState("packed", "slice long, pack long", "calls binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, size, packs = [], 0, self.state.get()[2] if self.state.exists() else 0
        for pdf in chain(rows, [None]):
            if pdf is not None:
                calls = np.empty(len(pdf), CALL)
                calls["at"], calls["ok"] = pdf["at"], pdf["ok"]
                held.append(calls)
                size += len(calls)
            if size >= PACKED or (pdf is None and size):
                self.pack(np.concatenate(held), packs)
                held, size, packs = [], 0, packs + 1
        return self.advance(key, timerValues, packs)

    def pack(self, calls: np.ndarray, number: int) -> None:
        calls = calls[np.lexsort((calls["ok"], calls["at"]))]
        which = calls["at"] // SLICE
        cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(calls)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.waiting.updateValue((int(which[a]), number), (calls[a:b].tobytes(),))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return self.advance(key, timerValues, self.state.get()[2])

    def advance(self, key: tuple, times: TimerValues, packs: int) -> Iterator[pd.DataFrame]:
        now = times.getCurrentWatermarkInMs()
        held = self.state.get() if self.state.exists() else None
        state, out, following = (int(held[0]), None if held[1] is None or held[1] < 0 else int(held[1])) if held else (0, None), [], None
        for number, own in groupby(sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()), key=lambda k: k[0]):
            names = list(own)
            calls = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], CALL) for k in names])
            calls = calls[np.lexsort((calls["ok"], calls["at"]))]
            due = int(np.searchsorted(calls["at"], now, "right"))
            state, told = transitions(state, calls["at"][:due], calls["ok"][:due])
            out += told
            if due:
                for k in names:
                    self.waiting.removeKey(k)
            if due < len(calls):
                if due:
                    self.waiting.updateValue((number, packs), (calls[due:].tobytes(),))
                    packs += 1
                following = int(calls["at"][due])
                break
        state, told = until(state, now)
        out += told
        self.state.update((state[0], -1 if state[1] is None else state[1], packs))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if then := [t for t in (following, None if state[1] is None else state[1] + RESET * 1000) if t is not None]:
            self.handle.registerTimer(min(then))
        if out:
            yield pd.DataFrame([(key[0], at, name, n) for at, name, n in out], columns=["backend", "at", "became", "failures"])

    def close(self) -> None:
        pass


def breaker_log(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """backend, at, became (open, half_open), failures: what breakers did over a stream of calls (backend, ok, ts), in the order of time.

    A call counts once the watermark has passed it; one that comes after that is left out. That a breaker lets calls through again is told by a timer,
    whether calls come or not. Only calls within the watermark's delay are kept, and one without a time is none. Needs a state store that has timers: ``STORE`` as the session's provider.
    """
    rows = calls.where("ts IS NOT NULL").select("backend", F.coalesce("ok", F.lit(False)).alias("ok"), "ts", F.unix_millis("ts").alias("at")).withWatermark("ts", late)
    told = rows.groupBy("backend").transformWithStateInPandas(statefulProcessor=_Breaker(), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")
    return told.withColumn("at", F.timestamp_millis("at"))


def breaker_step(state: tuple[str, int, float], ok: bool, at: float) -> tuple[str, int, float]:
    """(state, failures in a row, opened at) after a call's outcome at a time."""
    name, failures, opened = state
    if name == "open" and at - opened >= RESET:
        name = "half_open"
    if ok:
        return ("closed", 0, 0.0) if name != "open" else state
    failures += 1
    if name == "half_open" or failures >= THRESHOLD:
        return "open", failures, at
    return name, failures, opened


def breakers(calls: DataFrame) -> DataFrame:
    """backend, state, failures after each batch of calls (backend, ok, at), kept as keyed state of the stream."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("at")
        for ok, at in zip(rows["ok"], rows["at"], strict=True):
            now = breaker_step(now, bool(ok), float(at))
        state.update(now)
        yield pd.DataFrame([(key[0], now[0], now[1])], columns=["backend", "state", "failures"])

    return calls.groupBy("backend").applyInPandasWithState(run, "backend string, state string, failures int", "state string, failures int, opened double", "update", GroupStateTimeout.NoTimeout)
