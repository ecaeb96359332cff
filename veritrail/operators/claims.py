"""Operators over tables of claims in the order of their response."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_references(claims: DataFrame) -> DataFrame:
    """``claims`` (response_id, pos, claim, subject) with resolved: a leading he, she or it becomes the latest
    subject before it; "they" stays, and so does a pronoun with nothing before it."""
    w = Window.partitionBy("response_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("subject", ignorenulls=True).over(w)
    p = r"(?i)^\s*(he|she|it)\b"
    out = F.when(F.col("claim").rlike(p) & F.col("__last").isNotNull(), F.concat("__last", F.regexp_replace("claim", p, ""))).otherwise(F.col("claim"))
    return claims.withColumn("__last", last).withColumn("resolved", out).drop("__last")
