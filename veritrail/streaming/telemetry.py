"""Telemetry of jobs and stages (job_id, stage, ts, status, latency_ms, event_id).

The aggregations work on tables and on streams alike; ``stream_*`` set watermarks and output modes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.ranks import with_percentiles


def latest_progress(events: DataFrame) -> DataFrame:
    """The newest event of each job."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(F.max("ts").alias("ts"), F.max_by("stage", at).alias("stage"), F.max_by("status", at).alias("status"))


def stage_duration(events: DataFrame) -> DataFrame:
    g = events.groupBy("job_id", "stage").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    return g.withColumn("duration_ms", F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")))


def latency_rollup(events: DataFrame, exact: bool = True) -> DataFrame:
    hourly = events.withColumn("hour", F.date_trunc("hour", "ts"))
    simple = [F.count("*").alias("n"), F.avg("latency_ms").alias("mean")]
    shares = {"p50": 0.5, "p95": 0.95}
    if not exact:
        return hourly.groupBy("hour", "stage").agg(*simple, *(F.percentile_approx("latency_ms", x).alias(n) for n, x in shares.items()))
    return with_percentiles(hourly.groupBy("hour", "stage").agg(*simple), hourly, "latency_ms", shares, ["hour", "stage"])


def failed_jobs(events: DataFrame, critical: list[str]) -> DataFrame:
    """failed: a critical stage of the job failed."""
    bad = F.col("status") == "failed"
    return events.groupBy("job_id").agg(F.bool_or(bad & F.col("stage").isin(critical)).alias("failed"), F.count_if(bad).alias("n_failed"))


def retry_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "stage").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), F.max_by("status", F.struct("ts", "event_id")).alias("final_status"))


def retention(events: DataFrame, days: int) -> DataFrame:
    """deleted, kept: jobs whose last event is more than ``days`` older than the newest of all, and the others."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("m"))
    old = F.col("last") < F.col("m") - F.expr(f"INTERVAL {days} DAYS")
    return last.crossJoin(F.broadcast(newest)).agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))  # newest: one row


def job_state(events: DataFrame, running: Column, terminal: Column) -> DataFrame:
    return events.groupBy("job_id").agg(F.min(F.when(running, F.col("ts"))).alias("started_at"), F.max(F.when(terminal, F.col("ts"))).alias("completed_at"), F.max_by("status", F.struct("ts", "event_id")).alias("state"))


#: What a job's state keeps, and what a stream of jobs tells.
_LATEST = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("n_events", T.LongType())])
_TOLD = T.StructType([T.StructField("job_id", T.LongType()), *_LATEST.fields, T.StructField("ended", T.BooleanType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobTracker(StatefulProcessor):
    """Latest event of each job, kept until the job has been idle for ``idle_ms`` of event time.

    Each batch tells the latest event of the jobs it touches. A timer at the last event's time plus ``idle_ms`` ends
    the job: it is told once more, as ended, and its state goes, so state is bounded by the jobs of that time. A job
    that comes back later begins anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", _LATEST)

    def _row(self, key, state, ended: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state, ended)], columns=_TOLD.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.latest.get() if self.latest.exists() else None
        best, n = ((old[0], old[1], old[2], old[3]), old[4]) if old else (None, 0)
        for part in rows:
            n += len(part)
            at = part.sort_values(["ts", "event_id"]).iloc[-1]
            new = (at.ts.to_pydatetime(), int(at.event_id), at.stage, at.status)
            best = new if best is None or (pd.Timestamp(new[0]), new[1]) > (pd.Timestamp(best[0]), best[1]) else best
        self.latest.update((*best, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(best[0]).timestamp() * 1000) + self.idle_ms)
        yield self._row(key, (*best, n), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.latest.get()
        self.latest.clear()
        yield self._row(key, tuple(state), True)

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, late: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """job_id, ts, event_id, stage, status, n_events, ended of a stream: its jobs' latest events, and their ends after ``idle``.

    The state store has to be ``ROCKS`` (spark.sql.streaming.stateStore.providerClass).
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "stage", "status").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobTracker(idle_ms), outputStructType=_TOLD, outputMode="Update", timeMode="EventTime")


def latest_told(told: DataFrame) -> DataFrame:
    """Of what ``track_jobs`` has told so far: the newest event of each job, as ``latest_progress`` gives it."""
    at = F.struct("ts", "event_id")
    return told.where("NOT ended").groupBy("job_id").agg(F.max("ts").alias("ts"), F.max_by("stage", at).alias("stage"), F.max_by("status", at).alias("status"))


def stream_rollup(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rollup of a stream by window and stage; windows close ``late`` after their end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage")
    return w.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean"), F.percentile_approx("latency_ms", 0.95).alias("p95")).select("w.start", "stage", "n", "mean", "p95")


def stream_durations(starts: DataFrame, ends: DataFrame, most: str = "1 hour") -> DataFrame:
    """job_id, stage, duration_ms of start and end events of streams, joined within ``most``."""
    a = starts.select("job_id", "stage", F.col("ts").alias("t0")).withWatermark("t0", most).alias("a")
    b = ends.select("job_id", "stage", F.col("ts").alias("t1")).withWatermark("t1", most).alias("b")
    on = (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.stage") == F.col("b.stage")) & (F.col("t1") >= F.col("t0")) & (F.col("t1") <= F.col("t0") + F.expr(f"INTERVAL {most}"))
    return a.join(b, on).select("a.job_id", "a.stage", (F.unix_millis(F.col("t1").cast("timestamp")) - F.unix_millis(F.col("t0").cast("timestamp"))).alias("duration_ms"))


def stream_scoring(queries: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch of arriving queries; its results are a folder ``batch=n`` of Parquet under ``path``.

    A batch that is run again after a failure replaces its folder, so no result is there twice.
    """

    def write(df: DataFrame, n: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
