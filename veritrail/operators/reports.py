"""Reports over responses, errors and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of errors, in the order in which they are tried.
ERRORS = ["entity_ambiguity", "wrong_retrieval", "claim_extraction", "ensemble_disagreement", "evidence_conflict", "verification", "confidence_calibration", "unknown"]


def fuse_with_disagreement(internal: Column, external: Column, decision: Column, confidence: Column, weight: float = 0.5) -> Column:
    """struct(probability, decision, confidence): weighted mean; far apart scores cost confidence; between 0.33 and 0.66 the external decision stands."""
    p = weight * internal + (1 - weight) * external
    d = F.when(p >= 0.66, "yes").when(p <= 0.33, "no").otherwise(decision)
    return F.struct(p.alias("probability"), d.alias("decision"), (confidence * (1 - F.abs(internal - external))).alias("confidence"))


def error_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """category, n: each row counts for the first of ``ERRORS`` whose flag holds; all categories are listed."""
    cat = F.lit("unknown")
    for name in reversed(ERRORS[:-1]):
        if name in flags:
            cat = F.when(flags[name], name).otherwise(cat)
    every = rows.sparkSession.createDataFrame([(e,) for e in ERRORS], "category string")
    return every.join(rows.groupBy(cat.alias("category")).agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def faithfulness(words: DataFrame, supported: Column) -> DataFrame:
    """Share of each response's words (response_id, w; with repeats) that its supported claims hold; ``supported``: whether a row is of one."""
    held = F.coalesce(F.max(supported) & F.col("w").isNotNull() & F.col("response_id").isNotNull(), F.lit(False))
    each = words.groupBy("response_id", "w").agg(F.count("*").alias("n"), held.alias("held"))
    return each.groupBy("response_id").agg((F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)) / F.sum("n")).alias("faithfulness"))


def evidence_report(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sorted sources, supporting items and contradictions of each response."""
    j = claims.join(evidence, "claim_id", "left")
    return j.groupBy("response_id").agg(
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count_if((F.col("verdict") == "supported") & F.col("source").isNotNull()).alias("n_supporting"),
        F.countDistinct(F.when(F.col("verdict") == "contradicted", F.col("claim_id"))).alias("n_contradictions"),
    )


def feature_diagnostics(vectors: DataFrame) -> DataFrame:
    """Of each class (label, v: unit vectors): n, length of the mean, mean spread, and the mean cosine of its pairs.

    The mean of all products is the squared length of the mean vector, so no pairs are made.
    """
    dims = vectors.select("label", F.posexplode("v").alias("dim", "x"))
    per = dims.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_length"), F.avg("s").alias("mean_spread"), F.sum(F.col("m") * F.col("m")).alias("within_cosine"))


def class_summaries(vectors: DataFrame) -> DataFrame:
    """label, dim, n, m, var, u: of each class and dimension the mean, variance, and mean of the rows' unit vectors (label, v).

    Counts, sums and sums of squares add up, so tasks pass on one row a class and dimension.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    dims = vectors.select("label", norm.alias("norm"), F.posexplode("v").alias("dim", "x"))
    return dims.groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("var"), F.avg(F.col("x") / F.col("norm")).alias("u"))


def class_distances(vectors: DataFrame) -> DataFrame:
    """label_a, label_b (a before b): distance of the classes' means, and the mean cosine over pairs of their rows.

    The mean of the cosines of all pairs is the product of the classes' mean unit vectors, so no pairs of rows are made.
    """
    s = class_summaries(vectors)
    a = s.select("dim", F.col("label").alias("label_a"), F.col("m").alias("ma"), F.col("u").alias("ua"))
    b = s.select("dim", F.col("label").alias("label_b"), F.col("m").alias("mb"), F.col("u").alias("ub"))
    j = a.join(b, "dim").where("label_a < label_b")
    return j.groupBy("label_a", "label_b").agg(F.sqrt(F.sum(F.pow(F.col("ma") - F.col("mb"), F.lit(2)))).alias("centroid_distance"), F.sum(F.col("ua") * F.col("ub")).alias("cosine"))


def feature_totals(vectors: DataFrame, near_zero: float = 1e-6) -> DataFrame:
    """Mean variance of the dimensions over all classes, the number of those without any, and the mean length of a row."""
    length = vectors.agg(F.avg(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("mean_l2"))
    dims = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("var"))
    return dims.agg(F.avg("var").alias("variance"), F.count_if(F.col("var") < near_zero).alias("near_zero_dims")).crossJoin(length)  # one row each


def level(confidence: Column) -> Column:
    """How large the uncertainty 1 - confidence is, in words."""
    u = 1.0 - confidence
    return F.when(u <= 0.10, "Very Low").when(u <= 0.25, "Low").when(u <= 0.50, "Moderate").when(u <= 0.75, "High").otherwise("Very High")


def propagated(stages: dict[str, Column]) -> dict[str, Column]:
    """overall (geometric mean of the stages' confidences, cut to 0.0001..1), its level, and each stage's level."""
    logs = [F.ln(F.greatest(F.lit(1e-4), F.least(F.lit(1.0), c))) for c in stages.values()]
    overall = F.round(F.exp(sum(logs[1:], logs[0]) / len(logs)), 4)
    return {"overall": overall, "level": level(overall)} | {f"{name}_level": level(c) for name, c in stages.items()}
