"""Ranks and percentiles within groups, without a sort of a whole group in one task.

Both work on two levels: rows are counted by ranges of the value within each group, running totals over the few
ranges give offsets, and only rows of one range are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw that make a range (16 ** 3 ranges a group), and bounds between ranges of values.
DIGITS, BOUNDS, ACCURACY = 3, 255, 10_000


def draw(key: str, seed: int) -> Column:
    """A fixed random order of the rows."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def _joined(rows: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``few`` for equal values of ``by``; nulls are equal."""
    named = few.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), *(c for c in few.columns if c not in by))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.lit(True))
    return rows.join(named, on, how).drop(*(f"__by{i}" for i in range(len(by))))


def draw_ranked(df: DataFrame, by: list[str], key: str, seed: int, most: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """``df`` with __rank (from 1, by draw and key within ``by``), __n (rows of the group) and __draw.

    Draws are spread evenly, so the first ``digits`` of one are a range of about n / 16 ** digits rows; a group's
    offsets are as many numbers. ``most`` (an expression of the group's columns and __n) keeps ranks up to it
    only, and then rows of later ranges are left out before anything is sorted.
    """
    rows = df.withColumn("__draw", draw(key, seed)).withColumn("__range", F.substring("__draw", 1, digits))
    counts = rows.groupBy(*by, "__range").agg(F.count("*").alias("__in"))
    group = Window.partitionBy(*by)
    offsets = counts.withColumns({"__before": F.coalesce(F.sum("__in").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__in").over(group)}).drop("__in")
    if most is not None:
        offsets = offsets.where(F.col("__before") < most)
    out = _joined(rows, offsets, [*by, "__range"])
    out = out.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__draw", key)))
    if most is not None:
        out = out.where(F.col("__rank") <= most)
    return out.drop("__range", "__before")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = (), bounds: int = BOUNDS) -> DataFrame:
    """Exact percentiles (interpolated between neighbours) of ``value`` in each group: one column a share; nulls don't count.

    A mergeable sketch cuts each group's values into ranges of about equal counts; where it errs, only the
    ranges' sizes suffer. Counts of the ranges tell which of them hold the wanted places, and running counts are
    made in those alone, over distinct values.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("__v", [(i + 1) / (bounds + 1) for i in range(bounds)], ACCURACY).alias("__cuts"))
    ranged = _joined(counts, cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row
    ranged = ranged.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    group = Window.partitionBy(*by)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__c").alias("__in"))
    totals = totals.withColumns({"__before": F.coalesce(F.sum("__in").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__in").over(group)})
    # the places on both sides of each share, in the range that holds them
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (f((F.col("__n") - 1) * F.lit(share))).cast("long").alias("at")) for name, share in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]))
    places = totals.withColumn("__p", place).where((F.col("__p.at") >= F.col("__before")) & (F.col("__p.at") < F.col("__before") + F.col("__in")))
    wanted = places.groupBy(*by, "__range").agg(F.first("__before").alias("__before"), F.first("__n").alias("__n"), F.collect_list("__p").alias("__ps"))
    inside = _joined(ranged, wanted, [*by, "__range"])
    upto = F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__before")
    inside = inside.withColumn("__upto", upto).select(*by, "__v", "__n", "__upto", "__c", F.explode("__ps").alias("__p")).where((F.col("__p.at") < F.col("__upto")) & (F.col("__p.at") >= F.col("__upto") - F.col("__c")))
    at = lambda name, side: F.max(F.when((F.col("__p.name") == name) & (F.col("__p.side") == side), F.col("__v")))
    out = inside.groupBy(*by).agg(F.first("__n").alias("__n"), *(at(n, s).alias(f"__{n}_{s}") for n in shares for s in ("low", "high")))

    def between(name: str, share: float) -> Column:
        exact = (F.col("__n") - 1) * F.lit(share)
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return (low + (high - low) * (exact - F.floor(exact))).alias(name)

    return out.select(*by, *(between(n, s) for n, s in shares.items()))


def with_percentiles(groups: DataFrame, df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``groups`` (one row for each value of ``by``) with the percentiles of ``df``; null where a group has no value."""
    found = percentiles(df, value, shares, by)
    return _joined(groups, found, list(by), "left") if by else groups.join(found, how="left")  # one row each
