"""Verdicts rolled up to claims and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def valid_evidence(evidence: DataFrame, least: float = 0.15) -> DataFrame:
    """Evidence (claim_id, score, ...) of ``least`` and more; all of a claim's if none is. A null score counts as 0.5."""
    good = F.coalesce(F.col("score"), F.lit(0.5)) >= least
    return evidence.withColumn("__some", F.max(good.cast("int")).over(Window.partitionBy("claim_id"))).where(good | (F.col("__some") == 0)).drop("__some")


def hallucination_score(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """Score and confidence of each response from its claims (verdict, confidence, fabricated); 0 and 0 without claims."""
    v = F.col("verdict")
    weight = F.when(v == "supported", 0.0).when(v == "contradicted", 1.0).otherwise(0.5)
    weight = F.when(F.col("fabricated") & (v != "supported"), F.greatest(weight, F.lit(0.85))).otherwise(weight)
    g = claims.groupBy("response_id").agg(F.avg(weight).alias("s"), F.avg(F.coalesce("confidence", F.lit(0.3))).alias("c"), F.bool_and(v == "supported").alias("fine"))
    conf = F.when(F.col("fine"), F.greatest(F.lit(0.95), F.least(F.lit(0.98), F.col("c") + 0.18))).otherwise(F.col("c"))
    return responses.join(g, "response_id", "left").select("response_id", F.coalesce(F.round("s", 4), F.lit(0.0)).alias("hallucination_score"), F.coalesce(F.round(conf + 1e-9, 3), F.lit(0.0)).alias("confidence"))


def claim_confidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """support_count, agreement, evidence_quality and confidence of each claim (claim_id, verdict)."""
    e = evidence.groupBy("claim_id").agg(F.countDistinct("source").alias("n"), F.avg("score").alias("q"), F.max("score").alias("top"))
    v = F.col("verdict")
    out = claims.join(e, "claim_id", "left").select(
        "claim_id", "verdict", F.when(v == "supported", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).otherwise(0).cast("long").alias("support_count"),
        F.when(v == "supported", 1.0).when(v == "contradicted", 0.0).otherwise(0.5).alias("agreement"), F.round(F.coalesce("q", F.lit(0.5)), 4).alias("evidence_quality"), F.coalesce("top", F.lit(0.5)).alias("top"),
    )
    n = F.col("support_count")
    floor = F.when((F.col("top") >= 0.9) & (n >= 2), 0.95).when(n >= 2, 0.92).otherwise(0.88)
    value = 0.40 * F.col("evidence_quality") + 0.35 * F.col("agreement") + 0.25 * F.least(F.lit(1.0), 0.5 * n)
    conf = F.when(v == "supported", F.round(F.greatest(floor, F.least(F.lit(0.98), value)), 2)).when(v == "contradicted", 0.90).otherwise(0.30)
    return out.select("claim_id", "support_count", "agreement", "evidence_quality", conf.alias("confidence"))


def response_summary(claims: DataFrame) -> DataFrame:
    """Counts of verdicts, status, support and evidence probability of each response."""
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    g = claims.groupBy("response_id").agg(F.count("*").alias("n"), is_("supported").alias("n_supported"), is_("partial").alias("n_partial"), is_("contradicted").alias("n_contradicted"))
    n, s, p, c = (F.col(x) for x in ("n", "n_supported", "n_partial", "n_contradicted"))
    support = (s + 0.5 * p) / n
    status = F.when(s == n, "Fully Supported").when(c > 0, "Contradicted").when(s + p > 0, "Partially Supported").otherwise("Insufficient Evidence")
    return g.withColumns({"status": status, "support": support, "p_evidence": F.least(F.lit(1.0), 1 - support + 0.25 * c / n)})


def fused(internal: Column, evidence: Column, contradicted: Column, fully_supported: Column, threshold: float, weight: float = 0.70) -> Column:
    """Weighted probability; at least threshold + 0.15 on a contradiction, at most 0.75 threshold if fully supported."""
    p = weight * internal + (1 - weight) * evidence
    p = F.when(contradicted, F.greatest(p, F.lit(threshold + 0.15))).when(fully_supported, F.least(p, F.lit(0.75 * threshold))).otherwise(p)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def span_coverage(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """Share of each response's characters that its claims cover, found by their first 30; overlaps count once."""
    src = texts.select("response_id", F.lower(strip(F.col("text"))).alias("src"))
    c = claims.select("response_id", F.lower(strip(F.col("claim"))).alias("c")).join(src, "response_id")
    st = F.expr("locate(substring(c, 1, 30), src)")
    spans = c.select("response_id", F.length("src").alias("n"), st.alias("st"), F.length("c").alias("k")).where("st > 0").withColumn("en", F.least(F.col("n") + 1, F.col("st") + F.col("k")))
    w = Window.partitionBy("response_id").orderBy("st", "en").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("en") - F.greatest(F.col("st"), F.coalesce(F.max("en").over(w), F.lit(0))))
    got = spans.withColumn("new", new).groupBy("response_id").agg((F.sum("new") / F.max("n")).alias("v"))
    return texts.select("response_id").join(got, "response_id", "left").select("response_id", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("coverage"))


def explain(claims: DataFrame) -> DataFrame:
    """counts line and the claims of each class, by lower-cased text."""
    n = lambda x: F.count_if(F.col("verdict") == x).cast("string")
    row = F.struct(F.lower("text").alias("k"), "verdict", "text")
    of = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == x, row))), lambda r: r["text"]), " ")
    counts = F.concat(n("supported"), F.lit(" supported, "), n("contradicted"), F.lit(" contradicted, "), n("insufficient"), F.lit(" insufficient"))
    return claims.groupBy("response_id").agg(counts.alias("counts"), of("supported").alias("supported"), of("insufficient").alias("insufficient"))
