"""Queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import reports as P
from .q_metrics import _BINS, _CM, _closed, a31
from .q_retrieval import a19
from .q_text import _ENT, _EV, _VER, sql_normalized, sql_words, verified
from .registry import SQL, query, table
from .views import PRED, TEMPLATED, TEMPLATED_ROWS, predictions, templated


@query("A07_fuse_scores_disagreement", f"WITH {PRED}, x AS (SELECT id, p, p2, 0.5 * p + 0.5 * p2 AS q FROM pred) SELECT id, q AS probability, CASE WHEN q >= 0.66 THEN 'yes' WHEN q <= 0.33 THEN 'no' ELSE 'uncertain' END AS decision, 0.9 * (1 - abs(p - p2)) AS confidence FROM x")
def a07(spark, d):
    return predictions(spark, d).select("id", P.fuse_with_disagreement(F.col("p"), F.col("p2"), F.lit("uncertain"), F.lit(0.9)).alias("x")).select("id", "x.*")


_FLAGS = {"entity_ambiguity": "toxic = 1", "ensemble_disagreement": "abs(p - p2) > 0.40", "verification": "y <> (CASE WHEN p >= 0.6 THEN 1 ELSE 0 END)", "confidence_calibration": "abs(p - 0.5) < 0.3"}


@query("A26_error_taxonomy_counts", f"WITH {PRED}, c AS (SELECT CASE " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in _FLAGS.items()) + " ELSE 'unknown' END AS category FROM pred), e(category) AS (VALUES " + ", ".join(f"('{e}')" for e in P.ERRORS) + ") SELECT e.category, count(c.category) AS n FROM e LEFT JOIN c ON c.category = e.category GROUP BY e.category")
def a26(spark, d):
    return P.error_counts(predictions(spark, d), {k: F.expr(v) for k, v in _FLAGS.items()})


_LONG = lambda x: f"list_filter(string_split({sql_normalized(x)}, ' '), lambda w: length(w) > 2)"


@query("A09_faithfulness", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, w AS (SELECT response_id, verdict, unnest({_LONG('text')}) AS w FROM ver), s AS (SELECT DISTINCT response_id, w FROM w WHERE verdict = 'supported') SELECT w.response_id, avg((s.w IS NOT NULL)::INT) AS faithfulness FROM w LEFT JOIN s ON s.response_id = w.response_id AND s.w = w.w GROUP BY w.response_id")
def a09(spark, d):
    long = F.filter(F.split(T.normalized(F.col("text")), " "), lambda w: F.length(w) > 2)
    w = verified(spark, d).select("response_id", "verdict", F.explode(long).alias("w"))
    n = (table(spark, d, "orders").count() + table(spark, d, "supplier").count()) // TEMPLATED_ROWS + 1
    return P.faithfulness(w.repartition(n, "response_id"), F.col("verdict") == "supported")


@query("A40_evidence_report", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, j AS (SELECT v.response_id, v.claim_id, verdict, source FROM ver v LEFT JOIN evidence e USING (claim_id)) SELECT response_id, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ','), '') AS sources, count(*) FILTER (verdict = 'supported' AND source IS NOT NULL) AS n_supporting, count(DISTINCT claim_id) FILTER (verdict = 'contradicted') AS n_contradictions FROM j GROUP BY response_id")
def a40(spark, d):
    return P.evidence_report(verified(spark, d).select("claim_id", "response_id", "verdict"), templated(spark, d)[1].select("claim_id", "source"))


@query("A36_feature_diagnostics", "WITH x AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS r(i)), p AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT label, max(n) AS n, sqrt(sum(m * m)) AS mean_length, avg(s) AS mean_spread, sum(m * m) AS within_cosine FROM p GROUP BY label")
def a36(spark, d):
    return P.feature_diagnostics(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")))


_UNIT = "SELECT label, i, v[i] AS x, v[i] / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8) AS u FROM (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, 65)) AS r(i)"


@query("A36_class_distances", f"WITH x AS ({_UNIT}), p AS (SELECT label, i, avg(x) AS m, avg(u) AS u FROM x GROUP BY ALL) SELECT a.label AS label_a, b.label AS label_b, sqrt(sum(pow(a.m - b.m, 2))) AS centroid_distance, sum(a.u * b.u) AS cosine FROM p a JOIN p b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def a36d(spark, d):
    return P.class_distances(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")))


@query("A36_feature_totals", f"WITH x AS ({_UNIT}), p AS (SELECT i, var_pop(x) AS var FROM x GROUP BY i), n AS (SELECT avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))) AS mean_l2 FROM embeddings) SELECT avg(var) AS variance, count(*) FILTER (var < 1e-6) AS near_zero_dims, any_value(mean_l2) AS mean_l2 FROM p, n")
def a36t(spark, d):
    return P.feature_totals(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")))


_LEVEL = lambda c: f"CASE WHEN 1.0 - {c} <= 0.10 THEN 'Very Low' WHEN 1.0 - {c} <= 0.25 THEN 'Low' WHEN 1.0 - {c} <= 0.50 THEN 'Moderate' WHEN 1.0 - {c} <= 0.75 THEN 'High' ELSE 'Very High' END"
_STAGES4 = ["extraction", "retrieval", "quality", "verification"]
_LN = lambda c: f"ln(greatest(1e-4, least(1.0, {c})))"


@query("A10_uncertainty_propagation", f"""WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, e AS (SELECT claim_id, max(score) AS top, avg(score) AS mean FROM evidence GROUP BY claim_id),
  g AS (SELECT response_id, avg(least(1.0, 6.0::DOUBLE / len(string_split(text, ' ')))) AS extraction, avg(coalesce(top, 0)) AS retrieval, avg(coalesce(mean, 0)) AS quality, avg(confidence) AS verification FROM ver v LEFT JOIN e USING (claim_id) GROUP BY response_id),
  o AS (SELECT *, round(exp(({' + '.join(map(_LN, _STAGES4))}) / 4), 4) AS overall FROM g) SELECT response_id, overall, {_LEVEL('overall')} AS level, {', '.join(f'{_LEVEL(s)} AS {s}_level' for s in _STAGES4)} FROM o""")
def a10(spark, d):
    """Stages: claims short enough to be atomic, best evidence, mean evidence, and the verdicts' confidence."""
    e = templated(spark, d)[1].groupBy("claim_id").agg(F.max("score").alias("top"), F.avg("score").alias("mean"))
    j = verified(spark, d).select("response_id", "claim_id", "text", "confidence").join(e, "claim_id", "left")
    g = j.groupBy("response_id").agg(
        F.avg(F.least(F.lit(1.0), 6.0 / F.size(F.split("text", " ")))).alias("extraction"), F.avg(F.coalesce("top", F.lit(0.0))).alias("retrieval"), F.avg(F.coalesce("mean", F.lit(0.0))).alias("quality"), F.avg("confidence").alias("verification")
    )
    out = P.propagated({s: F.col(s) for s in _STAGES4})
    return g.select("response_id", *(c.alias(n) for n, c in out.items()))


_FULL = ["accuracy", "f1", "mcc", "ece", "brier"]


@query("A41_benchmark_report", f"""WITH {PRED}, c AS (SELECT {_CM} FROM (SELECT y, (p >= 0.2)::INT AS h FROM pred)), m AS (SELECT {_closed()} FROM c), {_BINS}, a19 AS ({SQL['A19_retrieval_metrics']}), a31 AS ({SQL['A31_ablation_matrix']})
  SELECT * FROM (SELECT 'full' AS config, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT 'full', 'f1', f1 FROM m UNION ALL SELECT 'full', 'mcc', mcc FROM m UNION ALL SELECT 'full', 'ece', (SELECT sum(n * gap) / sum(n) FROM bi) UNION ALL SELECT 'full', 'brier', avg((p - y) * (p - y)) FROM pred
    UNION ALL SELECT 'retrieval', 'recall', recall FROM a19 UNION ALL SELECT 'retrieval', 'mrr', mrr FROM a19 UNION ALL SELECT 'retrieval', 'ndcg', ndcg FROM a19
    UNION ALL SELECT 'ablation ' || config, 'accuracy', accuracy FROM a31 UNION ALL SELECT 'ablation ' || config, 'f1', f1 FROM a31 UNION ALL SELECT 'ablation ' || config, 'f1_change', f1_change FROM a31)""")
def a41(spark, d):
    p = predictions(spark, d)
    m = M.classification_metrics(p.withColumn("h", (F.col("p") >= 0.2).cast("int")), "y", "h").select("accuracy", "f1", "mcc")
    one = m.crossJoin(M.ece(M.calibration_bins(p, "y", "p"))).crossJoin(p.agg(M.brier("y", "p").alias("brier")))  # one row each
    full = one.withColumn("config", F.lit("full")).unpivot("config", _FULL, "metric", "value")
    found = a19(spark, d).withColumn("config", F.lit("retrieval")).unpivot("config", ["recall", "mrr", "ndcg"], "metric", "value")
    ablated = a31(spark, d).withColumn("config", F.concat(F.lit("ablation "), "config")).unpivot("config", ["accuracy", "f1", "f1_change"], "metric", "value")
    return full.unionByName(found).unionByName(ablated)


_OPEN = r"regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '(?i)^(well|so|actually|in fact|yes|no|sure|of course|certainly),?\s+', '')"


@query("T13_strip_discourse_prefix", rf"""WITH {TEMPLATED}, x AS (SELECT claim_id, ['Actually, ', 'According to the records, ', 'In 1999, ', ''][pos + 1] || text AS s FROM claims),
  y AS (SELECT claim_id, regexp_replace(regexp_replace({_OPEN}, '(?i)^according to [^,]+,\s*', ''), '(?i)^(in|on|since|during|as of|by) [^,]{{1,40}},\s*', '') AS t FROM x) SELECT claim_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS claim FROM y""")
def t13(spark, d):
    lead = F.element_at(F.array(*map(F.lit, ["Actually, ", "According to the records, ", "In 1999, ", ""])), F.col("pos") + 1)
    return templated(spark, d)[0].select("claim_id", T.strip_discourse(F.concat(lead, "text")).alias("claim"))


@query("M17_hash_embedding", f"WITH w AS (SELECT doc_id, unnest({sql_words('text')}) AS w FROM documents), c AS (SELECT doc_id, (('0x' || md5(w)[1:8])::BIGINT % 32)::INT AS bucket, count(*)::DOUBLE AS n FROM w GROUP BY ALL) SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS value FROM c")
def m17(spark, d):
    """32 buckets of distinct words, of unit length."""
    w = table(spark, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    counted = w.groupBy("doc_id", (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % 32).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = counted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norm, "doc_id").select("doc_id", "bucket", (F.col("n") / F.col("norm")).alias("value"))


@query("S17_split_manifest")
def s17(spark, d):
    from ..sources.readers import file_digests

    return file_digests(spark, f"{d}/documents.parquet")
