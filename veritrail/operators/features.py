"""Features of (query, response, evidence), their schema, calibrators, and how attributions are judged."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip

#: Names and order of the features.
NAMES = [
    "semantic_similarity", "max_retrieval_confidence", "avg_retrieval_confidence", "entity_overlap_ratio", "temporal_consistency_score", "numeric_relative_error", "citation_coverage_ratio",
    "nli_contradiction_score", "nli_entailment_score", "nli_neutral_score", "semantic_available", "entity_available", "evidence_available", "nli_available", "numeric_available",
]


def _years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(19\d\d|20\d\d)\b"), F.lit(1)))


def _numbers(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), lambda n: n.cast("double")), lambda x: ~x.isin(1900.0, 2000.0))


def _sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def numeric_errors(response: Column, evidence: Column) -> Column:
    """Of each number of the response's sentences its relative distance to the nearest number in the evidence's sentence
    that has numbers and most words in common (the first of equals); 1 if no sentence has numbers."""

    def of(sentence: Column, numbered: Column) -> Column:
        rows = F.transform(numbered, lambda e, i: F.struct((-F.size(F.array_intersect(_words(sentence), _words(e)))).alias("hits"), i.alias("i"), e.alias("e")))
        near = lambda x, ys: F.array_min(F.transform(ys, lambda y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-5))))
        found = let(_numbers(F.array_min(rows)["e"]), lambda ys: F.transform(_numbers(sentence), lambda x: near(x, ys)))
        return F.when(F.size(numbered) > 0, found).when(evidence != "", F.transform(_numbers(sentence), lambda x: F.lit(1.0))).otherwise(F.array().cast("array<double>"))

    numbered = F.filter(_sentences(evidence), lambda e: F.size(_numbers(e)) > 0)
    return let(numbered, lambda ns: F.flatten(F.transform(F.filter(_sentences(response), lambda s: F.size(_numbers(s)) > 0), lambda s: of(s, ns))))


def explicit_features(rows: DataFrame) -> DataFrame:
    """``rows`` (query, response, evidence: array of texts, scores: array of numbers, and if given similarity,
    entity_overlap, nli: struct of contradiction, entailment, neutral) with the 15 features of ``NAMES``.

    What a model would say is taken from those columns; where they are null or missing it has its neutral
    value and its flag is 0. Without evidence the query stands in for it, but evidence_available stays 0.
    """
    for name, kind in (("similarity", "double"), ("entity_overlap", "double"), ("nli", "struct<contradiction:double,entailment:double,neutral:double>")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    texts = F.filter(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), strip), lambda t: t != "")
    real = F.size(texts) > 0
    r = rows.withColumn("__ev", F.when(real, F.array_join(texts, " ")).otherwise(strip(F.coalesce("query", F.lit("")))))
    ev, response = F.col("__ev"), F.coalesce("response", F.lit(""))
    r = r.withColumns({"__real": real, "__err": numeric_errors(response, ev), "__ry": _years(response), "__ey": _years(ev)})
    scores, some = F.filter(F.coalesce("scores", F.array().cast("array<double>")), lambda x: x.isNotNull()), F.when(F.col("__real"), 0.50).otherwise(0.0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    matched = F.size(F.array_intersect("__ry", "__ey")) / F.size("__ry")
    temporal = F.when(F.size("__ry") == 0, 0.50).when(F.size("__ey") > 0, matched).otherwise(0.0)
    own = F.transform(F.filter(F.split(strip(response), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.lower(F.regexp_replace(w, r"""^[.,!?"']+|[.,!?"']+$""", "")))
    covered = F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: (ev != "") & F.contains(F.lower(ev), w))) / F.size(own)).otherwise(0.0)
    sim = F.coalesce("similarity", F.lit(0.50))
    values = [
        sim, F.when(F.size(scores) > 0, F.array_max(scores)).otherwise(some), F.when(F.size(scores) > 0, mean(scores)).otherwise(some), F.coalesce("entity_overlap", F.lit(0.50)), temporal,
        F.when(F.size("__err") > 0, mean(F.col("__err"))).otherwise(0.0), covered, F.coalesce("nli.contradiction", 1.0 - sim), F.coalesce("nli.entailment", sim), F.coalesce("nli.neutral", F.greatest(F.lit(0.0), 1.0 - F.abs(sim - 0.5) * 2)),
        *[c.cast("double") for c in (F.col("similarity").isNotNull(), F.col("entity_overlap").isNotNull(), F.col("__real"), F.col("nli").isNotNull(), F.size("__err") > 0)],
    ]
    return r.withColumns({n: F.round(v, 4) for n, v in zip(NAMES, values)}).drop("__ev", "__real", "__err", "__ry", "__ey")


def schema_row(df: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """One row: the number of features and the SHA-256 of their names and types; an error if they are not as named."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = [n for n in names if have.get(n) != "double"]
    if missing:
        raise ValueError(f"features missing or not double: {missing}")
    order = [f.name for f in df.schema.fields if f.name in set(names)]
    if order != list(names):
        raise ValueError(f"features out of order: {order}")
    return df.sparkSession.range(1).select(F.lit(len(names)).alias("n_features"), F.sha2(F.lit(",".join(f"{n}:double" for n in names)), 256).alias("digest"))


def calibrated(df: DataFrame, y: str, inputs: list[str], name: str) -> DataFrame:
    """``df`` with the probability of a logistic regression on ``inputs``, with unit regularisation over all rows.

    On one probability that is Platt scaling; on an internal and an external one, a learned weighting of both.
    """
    n = df.count()
    m = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="__f"), LogisticRegression(featuresCol="__f", labelCol=y, regParam=1.0 / max(n, 1), standardization=False, probabilityCol="__p", predictionCol="__h", rawPredictionCol="__r")]).fit(df)
    return m.transform(df).withColumn(name, vector_to_array("__p")[1]).drop("__f", "__p", "__h", "__r")


def isotonic(df: DataFrame, y: str, p: str, name: str = "isotonic") -> DataFrame:
    """``df`` with the isotonic regression of ``y`` on ``p``; beyond the fitted range its ends."""
    m = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol=name).fit(df.withColumn(y, F.col(y).cast("double")))
    return m.transform(df.withColumn(p, F.col(p).cast("double")))


def ungrounded(words: Column, known: Column) -> Column:
    """For each word its parts of the score: struct(num, den), its length if ``known`` lacks it (else 0), and its length."""
    return F.transform(words, lambda w: F.struct(F.when(F.array_contains(known, w), 0).otherwise(F.length(w)).cast("double").alias("num"), F.length(w).cast("double").alias("den")))


def part_score(parts: Column) -> Column:
    """Score of a text from its words' parts: the share of its letters that are in ungrounded words; 0 without words."""
    total = lambda name: F.aggregate(parts, F.lit(0.0), lambda a, p: a + p[name])
    return F.when(F.size(parts) > 0, total("num") / total("den")).otherwise(0.0)


def deletion_scores(rows: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """id, k, original, top_deleted, random_deleted: the score of each text (id, parts) as it is, and with ``k`` words deleted.

    A word's attribution is what the score loses without it. Top words have the largest attribution, the
    earliest of equals first; random ones the smallest md5 of id, place and seed. The words that are left are scored
    anew. Scores are ratios of sums over words, so a text takes time in proportion to its words.
    """
    whole = lambda name: F.aggregate("parts", F.lit(0.0), lambda a, p: a + p[name])
    r = rows.select("id", "parts", whole("num").alias("n"), whole("den").alias("d"), part_score(F.col("parts")).alias("original"))
    without = lambda p: F.when(F.col("d") - p["den"] > 0, (F.col("n") - p["num"]) / (F.col("d") - p["den"])).otherwise(0.0)
    best = F.array_sort(F.transform("parts", lambda p, i: F.struct((without(p) - F.col("original")).alias("o"), i.alias("i"), p.alias("p"))))
    drawn = F.array_sort(F.transform("parts", lambda p, i: F.struct(F.md5(F.concat_ws(":", F.col("id").cast("string"), (i + 1).cast("string"), F.lit(str(seed)))).alias("o"), i.alias("i"), p.alias("p"))))
    r = r.select("id", "original", best.alias("best"), drawn.alias("drawn")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    left = lambda c: F.transform(F.slice(c, F.col("k") + 1, F.size(c)), lambda x: x["p"])
    return r.select("id", "k", "original", part_score(left(F.col("best"))).alias("top_deleted"), part_score(left(F.col("drawn"))).alias("random_deleted"))


def faithfulness_by_k(scores: DataFrame) -> DataFrame:
    """k, drops of the score when the top k, and k random, words go, their ratio and difference.

    ``scores``: k, original, top_deleted, random_deleted.
    """
    g = scores.groupBy("k").agg(F.avg(F.col("original") - F.col("top_deleted")).alias("top_drop"), F.avg(F.col("original") - F.col("random_deleted")).alias("random_drop"))
    ratio = F.when(F.col("random_drop") >= 0, F.col("top_drop") / (F.col("random_drop") + 1e-6)).otherwise(F.col("top_drop") / 1e-6)
    return g.select("k", "top_drop", "random_drop", ratio.alias("ratio"), (F.col("top_drop") - F.col("random_drop")).alias("gain"))


def attribution_consistency(maps: DataFrame) -> DataFrame:
    """seed_a, seed_b, cosine and spearman of each pair of seeds' attributions (seed, position, value).

    Ranks average over equal values. They are counted by value first, so a seed's window sorts distinct values.
    """
    counts = maps.groupBy("seed", "value").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seed").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("seed", "value", (before + (F.col("n") + 1) / 2).alias("r"))
    m = maps.join(ranks, ["seed", "value"])
    j = m.alias("a").join(m.alias("b"), (F.col("a.position") == F.col("b.position")) & (F.col("a.seed") < F.col("b.seed")))
    x, y = F.col("a.value"), F.col("b.value")
    g = j.groupBy(F.col("a.seed").alias("seed_a"), F.col("b.seed").alias("seed_b"))
    return g.agg((F.sum(x * y) / (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)) + 1e-8)).alias("cosine"), F.coalesce(F.nanvl(F.corr("a.r", "b.r"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def evidence_sufficiency(df: DataFrame, supported: str, predicted: str) -> DataFrame:
    """Share of rows whose support (1 or 0) is the opposite of the predicted hallucination (1 or 0)."""
    return df.agg(F.avg((F.col(supported) == 1 - F.col(predicted)).cast("double")).alias("sufficiency"))


def require_threshold_source(source: str) -> None:
    if source != "development_oof":
        raise ValueError(f"the threshold comes from {source!r}, not from out-of-fold development scores")


def oof_faults(oof: DataFrame, keys: DataFrame, key: str, score: str) -> DataFrame:
    """missing, repeated, not_finite, distinct_scores of out-of-fold scores against all keys: one row of counts."""
    s = F.col(score)
    have = oof.groupBy(key).agg(F.count("*").alias("c"))
    missing = keys.select(key).distinct().join(have, key, "left").agg(F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("c") > 1).alias("repeated"))
    shape = oof.agg(F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("not_finite"), F.countDistinct(score).alias("distinct_scores"))
    return missing.crossJoin(shape)  # one row each


def require_sound_oof(oof: DataFrame, keys: DataFrame, key: str, score: str) -> None:
    r = oof_faults(oof, keys, key, score).first()
    if r.missing or r.repeated or r.not_finite or r.distinct_scores < 2:
        raise ValueError(f"out-of-fold scores are not sound: {r.asDict()}")
