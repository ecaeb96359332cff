"""Streams give what the same aggregation gives on the whole table."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from veritrail.plans.views import stage_events
from veritrail.streaming import telemetry as E


def _stream(spark, sf_dir, tmp_path):
    stage_events(spark, sf_dir).repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(stage_events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _tracked(spark, tmp_path, schema, idle):
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = E.stream_scoring(E.track_jobs(src, "1 hour", idle), lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(E._TOLD).option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))


def test_jobs_end_and_go_over_a_restart(spark, rocks, tmp_path):
    """Two files, a restart, a third file: counts go on over the restart, idle jobs end once and lose their state."""
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    days = [
        [(1, "view", at(1, 0), "done", 1), (1, "click", at(1, 0), "done", 2), (2, "view", at(1, 1), "done", 3)],
        [(1, "cart", at(2, 0), "failed", 4), (3, "view", at(2, 1), "done", 5)],
        [(3, "click", at(9, 0), "done", 6), (4, "view", at(20, 0), "done", 7)],
        [(4, "click", at(20, 1), "done", 8), (2, "view", at(20, 2), "done", 9)],
    ]
    schema = "job_id long, stage string, ts timestamp, status string, event_id long"
    write = lambda day: spark.createDataFrame(days[day], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(0)
    write(1)
    _tracked(spark, tmp_path, schema, "5 days")
    write(2)
    _tracked(spark, tmp_path, schema, "5 days")
    write(3)
    told = _tracked(spark, tmp_path, schema, "5 days").collect()
    seen = sorted((r.job_id, r.ts.day, r.stage, r.status, r.n_events) for r in told if not r.ended)
    assert (1, 1, "click", "done", 2) in seen and (1, 2, "cart", "failed", 3) in seen  # equal times: the later event; the state went on
    assert (4, 20, "click", "done", 2) in seen and (2, 20, "view", "done", 1) in seen  # job 2 began anew after its end
    ends = [(r.job_id, r.stage) for r in told if r.ended]
    assert ends.count((1, "cart")) == 1 and ends.count((2, "view")) == 1 and not any(j == 4 for j, _ in ends)


def test_tracked_jobs_agree_with_the_table(spark, rocks, sf_dir, tmp_path):
    events = stage_events(spark, sf_dir)
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    told = _tracked(spark, tmp_path, events.schema, "4000 days")
    key = lambda df: sorted(map(str, df.select("job_id", F.col("ts").cast("timestamp"), "stage", "status").collect()))
    assert key(E.latest_told(told)) == key(E.latest_progress(events))


def test_durations_of_joined_streams(spark, sf_dir, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    for name, rows in (("a", [(1, "s", start), (2, "s", start), (3, "s", start)]), ("b", [(1, "s", start + datetime.timedelta(seconds=5)), (2, "s", start - datetime.timedelta(seconds=5)), (3, "s", start + datetime.timedelta(hours=2)), (1, "t", start)])):
        spark.createDataFrame(rows, "job_id long, stage string, ts timestamp").write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema("job_id long, stage string, ts timestamp").parquet(str(tmp_path / name))
    q = E.stream_scoring(E.stream_durations(read("a"), read("b")), lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    found = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in found.collect()] == [(1, "s", 5000)]


def test_rollup_with_watermark(spark, sf_dir, tmp_path):
    src = _stream(spark, sf_dir, tmp_path).withColumn("ts", F.col("ts").cast("timestamp"))
    q = E.stream_rollup(src, "400 days").writeStream.outputMode("update").format("memory").queryName("rollup").start()
    q.processAllAvailable()
    q.stop()
    total = spark.table("rollup").groupBy("start", "stage").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert total == stage_events(spark, sf_dir).count()


def test_scoring(spark, sf_dir, tmp_path):
    src = _stream(spark, sf_dir, tmp_path)
    q = E.stream_scoring(src, lambda df: df.select("job_id", (F.col("latency_ms") > 10).alias("slow")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == stage_events(spark, sf_dir).count()
