"""Progress that never falls, states that end, and messages in fragments: as state of a stream, and as windows over a table.

Both forms give the same rows for events that reach the stream in order; the tests hold one against the other.
State is kept in RocksDB by key (``spark.sql.streaming.stateStore.providerClass``) and expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clamped(progress: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(progress, F.lit(0.0))))


def batch_progress(events: DataFrame, *, key: str, order: str = "event_id", progress: str = "progress", state: str = "state", begin: str = "begin", terminal: dict[str, str]) -> DataFrame:
    """``key, order, progress, status``: the progress of each event's key up to then, between 0 and 1 and never falling, and its status.

    A state in ``terminal`` ends a run with the status it names and progress 1; events after it change nothing until ``begin`` starts a run
    anew at 0.  A ``begin`` within a run changes nothing.  Before the first ``begin`` a run is under way.  Null progress counts as none.
    """
    over = Window.partitionBy(key).orderBy(order)
    ends = F.coalesce(F.col(state).isin(list(terminal)), F.lit(False))
    mark = F.when(ends, F.col(state)).when(F.col(state) == begin, begin)
    # A begin counts where the last mark before it is an end: there a run starts.
    before = F.last(mark, True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.col(state) == begin) & before.isin(list(terminal))
    runs = events.withColumn("_run", F.count(F.when(F.coalesce(starts, F.lit(False)), 1)).over(over))
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first_end = F.first(F.when(ends, F.col(state)), True).over(inside)
    value = F.when(F.coalesce(F.col(state) == begin, F.lit(False)), F.lit(0.0)).otherwise(clamped(F.col(progress)))
    status = F.lit("building")
    for name, told in terminal.items():
        status = F.when(first_end == name, told).otherwise(status)
    return runs.select(key, order, F.when(first_end.isNotNull(), 1.0).otherwise(F.max(value).over(inside)).alias("progress"), status.alias("status"))


class Progress(StatefulProcessor):
    def __init__(self, key: str, order: str, progress: str, state: str, begin: str, terminal: dict[str, str], ttl_ms: int | None):
        self.names, self.begin, self.terminal, self.ttl_ms = (key, order, progress, state), begin, terminal, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "progress double, status string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, order, progress, state = self.names
        best, status = self.run.get() if self.run.exists() else (0.0, "building")
        given = pd.concat(list(rows)).sort_values(order)
        out = []
        for at, value, what in zip(given[order], given[progress], given[state]):
            if status != "building" and what == self.begin:
                best, status = 0.0, "building"
            elif status == "building" and what in self.terminal:
                best, status = 1.0, self.terminal[what]
            elif status == "building" and what != self.begin:
                best = max(best, min(1.0, max(0.0, 0.0 if pd.isna(value) else float(value))))
            out.append((key[0], at, best, status))
        self.run.update((best, status))
        yield pd.DataFrame(out, columns=[name, order, "progress", "status"])

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame, *, key: str, order: str = "event_id", progress: str = "progress", state: str = "state", begin: str = "begin", terminal: dict[str, str], ttl_ms: int | None = 86_400_000) -> DataFrame:
    """``batch_progress`` over a stream, each micro-batch in the order of ``order``; a key's state goes ``ttl_ms`` after it last changed, or
    stays where that is None.  Expiry goes by the clock, so such a stream runs on until it is stopped, also with the trigger ``availableNow``."""
    kinds = dict(events.dtypes)
    processor = Progress(key, order, progress, state, begin, terminal, ttl_ms)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, progress double, status string"
    return events.select(key, order, progress, state).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def batch_calls(deltas: DataFrame, *, key: str, order: str, index: str = "index") -> DataFrame:
    """``key, index, id, name, arguments``: calls put together from fragments.  Of ``id`` and ``name`` the last that is not empty holds, ``arguments`` are
    joined in order; calls without id or name are left out."""
    said = F.array_sort(F.collect_list(F.when(F.coalesce("arguments", F.lit("")) != "", F.struct(order, "arguments"))))
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col(order)))
    joined = deltas.where(F.col(index).isNotNull()).groupBy(key, index).agg(last("id").alias("id"), last("name").alias("name"), F.array_join(F.transform(said, lambda x: x["arguments"]), "").alias("arguments"))
    return joined.where(F.col("id").isNotNull() & F.col("name").isNotNull())


class Calls(StatefulProcessor):
    """A map from a call's index to what its fragments have said so far."""

    def __init__(self, key: str, order: str, index: str, ttl_ms: int | None, index_kind: str):
        self.names, self.ttl_ms, self.index_kind = (key, order, index), ttl_ms, index_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", f"i {self.index_kind}", "id string, name string, arguments string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, order, index = self.names
        given = pd.concat(list(rows)).sort_values(order)
        touched = {}
        for i, id_, called, said in zip(given[index], given["id"], given["name"], given["arguments"]):
            if not pd.isna(i):
                i = int(i)
                if i not in touched:
                    touched[i] = tuple(self.calls.getValue((i,))) if self.calls.containsKey((i,)) else ("", "", "")
                a, b, c = touched[i]
                touched[i] = (id_ or a, called or b, c + (said or ""))
        for i, call in touched.items():
            self.calls.updateValue((i,), call)
        yield pd.DataFrame([(key[0], i, *call) for i, call in touched.items() if call[0] and call[1]], columns=[name, index, "id", "name", "arguments"])

    def close(self) -> None:
        pass


def stream_calls(deltas: DataFrame, *, key: str, order: str, index: str = "index", ttl_ms: int | None = 3_600_000) -> DataFrame:
    """The calls of each key that a micro-batch has touched, as far as they have come; the last row of each is what ``batch_calls`` gives."""
    kinds = dict(deltas.dtypes)
    schema = f"`{key}` {kinds[key]}, `{index}` {kinds[index]}, id string, name string, arguments string"
    given = deltas.select(key, order, index, "id", "name", "arguments")
    return given.groupBy(key).transformWithStateInPandas(Calls(key, order, index, ttl_ms, kinds[index]), schema, "Update", "ProcessingTime" if ttl_ms else "None")


class Waiting(StatefulProcessor):
    """Requests that wait for their key's next answer, each with a timer."""

    def __init__(self, key: str, limit_ms: int):
        self.key, self.limit_ms = key, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "event_id long", "at long")
        self.answers = handle.getMapState("answers", "event_id long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).itertuples(index=False):
            at = int(r.at)
            (self.answers if r.answers else self.open).updateValue((int(r.event_id),), (at,))
            # All that can answer is known once the watermark has passed a request's limit; an answer is of use till then.
            self.handle.registerTimer(at // 1000 + self.limit_ms + 1)
        yield pd.DataFrame([], columns=["event_id", self.key, "answer_id", "outcome"]).astype({"event_id": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        limit = self.limit_ms * 1000
        answers = sorted((at[0], i[0]) for i, at in self.answers.iterator())
        out = []
        for (i,), (at,) in list(self.open.iterator()):
            if at // 1000 + self.limit_ms + 1 <= now:
                found = next((j for t, j in answers if at <= t <= at + limit), None)
                out.append((i, key[0], found, "timeout" if found is None else "answered"))
                self.open.removeKey((i,))
        for t, j in answers:
            if t // 1000 + self.limit_ms + 1 <= now:
                self.answers.removeKey((j,))
        frame = pd.DataFrame(out, columns=["event_id", self.key, "answer_id", "outcome"])
        frame["answer_id"] = frame["answer_id"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def stream_first_within(events: DataFrame, is_request: Column, is_answer: Column, seconds: int, *, key: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``event_id, key, answer_id, outcome`` of each request once its limit has passed: ``deadlines.first_within`` over a stream, whose state holds what the
    last ``seconds`` and the lateness allowed have brought."""
    given = events.where(is_request | is_answer).withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", late)
    told = given.select("event_id", key, F.unix_micros("_time").alias("at"), is_answer.alias("answers"), "_time")
    schema = f"event_id long, `{key}` {dict(events.dtypes)[key]}, answer_id long, outcome string"
    return told.groupBy(key).transformWithStateInPandas(Waiting(key, seconds * 1000), schema, "Append", "EventTime")
