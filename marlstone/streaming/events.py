"""Structured Streaming over the event log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.control import ACTIVE_START, TERMINAL, after_request, millis

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; the checkpoint's offsets are the cursor."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Append to a Parquet log, exactly once; ends when all that is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def once_per_key(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; what came before within the watermark is remembered."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type (an addition to what the batch side offers)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per session of a user (an addition to what the batch side offers)."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


#: State stores of ``transformWithStateInPandas`` need this provider.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEADLINE_MS = 12 * 3600 * 1000


class JobProcessor(StatefulProcessor):
    """Keeps a job's status, wishes and the time it was last heard of; by ``control.RULES``.

    With ``deadline_ms``, a timer fails a job that is prepared or run and not heard of
    for so long, and the same is found when its next request comes later than that; so
    states do not depend on how events are cut into batches.  With ``keep_ms``, the
    state of a job that has come to its end is forgotten after that time.
    """

    def __init__(self, start: str, deadline_ms: int | None, keep_ms: int | None):
        self.start, self.deadline_ms, self.keep_ms = start, deadline_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, pause boolean, cancel boolean, at long, timer long")

    def _put(self, state: tuple, at: int | None, timer: int | None) -> None:
        """Keep a state, and one timer: of the deadline, or of forgetting."""
        wait = self.deadline_ms if after_request(state, "deadline") != state else self.keep_ms if state[0] in TERMINAL else None
        due = at + wait if wait is not None and at is not None else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        self.job.update((*state, at, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *state, at, timer = self.job.get() if self.job.exists() else (self.start, False, False, None, None)
        state = tuple(state)
        batch = pd.concat(list(rows))
        for now, request in batch.sort_values(["at", "event_id"])[["at", "request"]].itertuples(index=False):
            if self.deadline_ms is not None and at is not None and now > at + self.deadline_ms:
                state = after_request(state, "deadline")
            state = after_request(state, request)
            at = int(now) if self.deadline_ms is not None or self.keep_ms is not None else None
        self._put(state, at, timer)
        yield pd.DataFrame({"job_id": [key[0]], "state": [state[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *state, at, _ = self.job.get()
        after = after_request(tuple(state), "deadline")
        if after == tuple(state):  # the job has ended, and its time is over
            self.job.clear()
            return
        self._put(after, at, None)
        yield pd.DataFrame({"job_id": [key[0]], "state": [after[0]]})

    def close(self) -> None:
        pass


def job_states(requests: DataFrame, start: str = ACTIVE_START, deadline_ms: int | None = None, keep_ms: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """job_id, state after each batch of requests (job_id, event_id, request), and when a timer changes it.

    With ``deadline_ms`` or ``keep_ms`` requests have a column ts, and timers go by its
    watermark, ``delay`` behind the latest; without them requests go by event_id alone.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = deadline_ms is not None or keep_ms is not None
    if timed:
        marked = requests.select("job_id", "event_id", "request", F.timestamp_millis(millis(F.col("ts"))).alias("ts")).withWatermark("ts", delay)
        rows = marked.withColumn("at", F.unix_millis("ts"))
    else:
        rows = requests.select("job_id", "event_id", "request", F.lit(0).cast("long").alias("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobProcessor(start, deadline_ms, keep_ms), outputStructType="job_id long, state string", outputMode="Update", timeMode="EventTime" if timed else "None"
    )


def after_cursor(stream: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """Events after a cursor that a reader brings along; from there on the checkpoint's offsets are the cursor."""
    return stream.filter(F.col(order) > cursor)


def follow(stream: DataFrame, terminal: Callable[[], bool], handle: Callable[[DataFrame, int], None], checkpoint: str, batch: int = 100, poll: float = 2.0) -> None:
    """Hand over batches until ``terminal()`` holds and a batch was short: what is there is read first, then asked again after ``poll`` seconds."""
    sizes: list[int] = []

    def each(df: DataFrame, i: int) -> None:
        sizes.append(df.count())
        handle(df, i)

    while True:
        done = terminal()
        sizes.clear()
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if done and sum(sizes) < batch:
            return
        time.sleep(poll)
