"""Writers of examples, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_examples(df: DataFrame, path: str) -> None:
    """Query, response, label (0 or 1), source, lang as JSON lines."""
    df.select("query", "response", F.col("label").cast("int").alias("label"), "source", F.col("language").alias("lang")).write.json(path)


def write_split_metadata(df: DataFrame, path: str, version: str) -> None:
    """Counts of each (source, split)."""
    df.groupBy("source", "split").agg(F.count("*").alias("total"), F.sum(F.col("label").cast("int")).alias("positives")).withColumn("version", F.lit(version)).write.json(path)


def write_results(results: DataFrame, claims: DataFrame, path: str) -> None:
    """One row for each job, and its claims with nested columns as JSON text."""
    results.write.mode("append").parquet(f"{path}/results")
    nested = [f.name for f in claims.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    claims.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").parquet(f"{path}/claims")


def report_rows(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """One row of metrics as (metric, value) rows, numbers only."""
    numbers = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short")]
    wide = metrics.select(*[F.col(c).cast("double").alias(prefix + c) for c in numbers])
    return wide.unpivot([], wide.columns, "metric", "value")


def markdown(report: DataFrame) -> str:
    """A few report rows as a table."""
    return "\n".join(["| Metric | Value |", "|-|-|", *[f"| {r.metric} | {r.value:.4f} |" for r in report.orderBy("metric").collect()]])


def append_log(record: DataFrame, path: str) -> None:
    """A run's record, by day."""
    record.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
