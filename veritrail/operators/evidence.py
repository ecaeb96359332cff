"""Ranking of retrieved evidence for claims, and what of it each claim is shown with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import jaccard, matches, strip


def evidence_mapping(claims: DataFrame, ranked: DataFrame) -> DataFrame:
    """claim_id, relation, sentences, strength: what each claim (claim_id, verdict) rests on.

    ``ranked``: id, rank, sentence, score, two sentences a claim at most. Support counts 0.78 at least; a
    claim without sentences has 0.85 if supported, else 0.50.
    """
    best = ranked.groupBy(F.col("id").alias("claim_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("s"), F.max("score").alias("score"))
    v = F.col("verdict")
    strength = F.when(v == "supported", F.coalesce(F.greatest(F.lit(0.78), "score"), F.lit(0.85))).otherwise(F.coalesce("score", F.lit(0.50)))
    relation = F.when(v == "supported", "supporting").when(v == "contradicted", "contradicting").otherwise("insufficient")
    none = F.array().cast("array<string>")
    return claims.join(best, "claim_id", "left").select("claim_id", relation.alias("relation"), F.coalesce(F.transform("s", lambda x: x["sentence"]), none).alias("sentences"), F.round(F.when(F.col("s").isNull() & (v == "supported"), 0.85).otherwise(strength), 2).alias("strength"))


def evidence_text(c: Column) -> Column:
    """Form under which a snippet counts as repeated."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\d+\]|\[citation needed\]|https?://\S+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([.!?,;])", "$1"), r"([.!?,;])\1+", "$1")
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def distinct_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def rank_evidence(rows: DataFrame, top_k: int, min_score: float = 0.10, raw: Column | None = None) -> DataFrame:
    """``rows`` (claim_id, claim, page_id, title, text, url) that rank among the first ``top_k`` of their claim, with score and rank.

    Pages that only list meanings go, unless a claim has nothing else. The score is the words' Jaccard
    similarity, or ``raw``; 0.25 more for a page about the claim's subject, 0.20 less for a derivative one.
    Of equal snippets of a page the best stays. If a page about the subject has 0.60, others need 0.20; if
    such a page is first with 0.80, fragments of its name, seasons, records and other side pages go.
    """
    by = Window.partitionBy("claim_id")
    title, claim = F.lower(strip(F.coalesce("title", F.lit("")))), F.lower("claim")
    subjects = F.transform(F.regexp_extract_all("claim", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0)), F.lower)
    lists = F.lower(F.concat_ws(" ", "title", "text")).rlike("disambiguation|may refer to")
    similar = raw if raw is not None else jaccard(distinct_words(F.col("claim")), distinct_words(F.coalesce("text", F.lit(""))))
    r = rows.withColumns({"__t": title, "__s": subjects, "__d": lists, "__raw": similar}).withColumn("__all", F.bool_and("__d").over(by)).where(~F.col("__d") | F.col("__all"))
    t = F.col("__t")
    subject = F.array_contains("__s", t)
    value = F.col("__raw") + F.when((t != "") & (subject | ((F.size(F.split(t, r"\s+")) > 1) & F.contains(claim, t))), 0.25).otherwise(0.0)
    for term in L.DERIVATIVE:
        value = value - F.when(t.contains(term) & ~claim.contains(term), 0.20).otherwise(0.0)
    r = r.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)).where(F.col("score") >= min_score)
    key = F.struct(F.lower(strip(F.coalesce("url", "title", F.lit("")))).alias("u"), F.substring(evidence_text(F.col("text")), 1, 300).alias("x"))
    r = r.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy("claim_id", "__key").orderBy(F.desc("score"), "page_id"))).where("__n = 1")
    canonical = F.max(((F.col("score") >= 0.60) & subject).cast("int")).over(by)
    r = r.withColumn("__c", canonical).where((F.col("__c") == 0) | (F.col("score") >= max(min_score, 0.20)))
    order = by.orderBy(F.desc("score"), "page_id")
    r = r.withColumns({"rank": F.row_number().over(order), "__top": F.first("score").over(order), "__first": F.first("__t").over(order)})
    about = (F.col("__top") >= 0.80) & F.exists("__s", lambda s: F.contains(F.col("__first"), s) | F.contains(s, F.col("__first")))
    fragment = (F.size(F.split(t, r"\s+")) == 1) & F.exists("__s", lambda s: F.contains(s, t))
    aside = t.rlike(r"\d{4}[–\-]\d{2,4}\b") | t.contains("records") | matches(t, L.TANGENTIAL)
    near = (F.col("score") >= 0.50) | F.exists("__s", lambda s: F.contains(t, s))
    r = r.where((F.col("rank") == 1) | ~about | (~fragment & ~aside & near))
    r = r.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return r.drop("__t", "__s", "__d", "__raw", "__all", "__key", "__n", "__c", "__top", "__first")

