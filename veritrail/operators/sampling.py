"""Samples, splits, folds, set operations and guards. All draws are functions of (id, seed).

Ranks within a stratum or label are made in two levels (``ranks``), so no task sorts a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import draw_ranked

_OWN = ("__rank", "__n", "__draw")


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, from each stratum in proportion: its rounded quota first, then the rest by draw."""
    total = df.agg(F.count("*").alias("__total"))
    # no row beyond the first ``size`` of its stratum can be taken
    r = draw_ranked(df, [stratum], key, seed, F.lit(size)).crossJoin(F.broadcast(total))  # one row
    late = F.col("__rank") > F.round(F.col("__n") * size / F.col("__total"))
    return r.withColumn("__late", late.cast("int")).orderBy("__late", "__draw", key).limit(size).drop(*_OWN, "__total", "__late")


def train_val_test(df: DataFrame, key: str, label: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """split: per label floor(train n), floor(val n), the rest."""
    r = draw_ranked(df, [label], key, seed)
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return r.withColumn("split", F.when(F.col("__rank") <= a, "train").when(F.col("__rank") <= a + b, "validation").otherwise("test")).drop(*_OWN)


def balanced_sample(df: DataFrame, key: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """Half of ``size`` (or all there are) from each label."""
    return draw_ranked(df, [label], key, seed, F.lit(size // 2)).drop(*_OWN)


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return draw_ranked(df, [label], key, seed).withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop(*_OWN)


def quota_sample(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """At most the given number of rows of each stratum; others are left out."""
    limit = F.lit(0)
    for s, n in quotas.items():
        limit = F.when(F.col(stratum) == s, n).otherwise(limit)
    return draw_ranked(df.where(F.col(stratum).isin(*quotas)), [stratum], key, seed, limit).drop(*_OWN)


def pair_key(query: str = "query", response: str = "response") -> list[Column]:
    return [F.lower(F.trim(F.col(query))).alias("q"), F.lower(F.trim(F.col(response))).alias("r")]


def contaminated(dev: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct normalised (query, response) pairs that both have."""
    return dev.select(*pair_key()).intersect(test.select(*pair_key()))


def require_clean(dev: DataFrame, test: DataFrame) -> None:
    n = contaminated(dev, test).count()
    if n:
        raise ValueError(f"{n} development examples are in the test set")


def require_no_label(features: DataFrame, label: str) -> None:
    if label in features.columns:
        raise ValueError(f"the label {label!r} is among the features")
