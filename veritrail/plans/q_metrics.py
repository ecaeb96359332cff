"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import resampling as B
from .registry import query
from .views import PRED, STAGES, predictions, stage_events

_CM = """count(*) FILTER (y = 1 AND h = 1) AS tp, count(*) FILTER (y = 0 AND h = 1) AS fp, count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 1 AND h = 0) AS fn"""
_R = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


def _closed(digits: int | None = 4, keep: str = "") -> str:
    """Closed forms over a relation c with tp, fp, tn, fn."""
    p, r, s = _R("tp", "tp+fp"), _R("tp", "tp+fn"), _R("tn", "tn+fp")
    pe = "((tp+fp)::DOUBLE*(tp+fn)+(tn+fn)::DOUBLE*(tn+fp))/((tp+fp+tn+fn)::DOUBLE*(tp+fp+tn+fn))"
    acc = _R("tp+tn", "tp+fp+tn+fn")
    forms = {
        "accuracy": acc, "precision": p, "recall": r, "specificity": s, "balanced_accuracy": f"(({r})+({s}))/2",
        "f1": f"CASE WHEN ({p})+({r}) <> 0 THEN 2*({p})*({r})/(({p})+({r})) ELSE 0 END",
        "mcc": f"CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) <> 0 THEN (tp::DOUBLE*tn-fp::DOUBLE*fn)/sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END",
        "kappa": f"CASE WHEN {pe} <> 1 THEN (({acc})-({pe}))/(1-({pe})) ELSE 0 END",
    }
    return keep + "tp, fp, tn, fn, " + ", ".join(f"round({v}, {digits}) AS {k}" if digits is not None else f"{v} AS {k}" for k, v in forms.items())


@query("A11_dataset_diagnostics", f"""WITH {PRED} SELECT coalesce(nullif(trim(source), ''), 'unknown') AS source, grouping(coalesce(nullif(trim(source), ''), 'unknown'))::INT AS is_total, count(*) AS total,
  sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, round(100.0 * sum(y)::DOUBLE / count(*), 4) AS pct FROM pred GROUP BY ROLLUP (coalesce(nullif(trim(source), ''), 'unknown'))""")
def a11(spark, d):
    src = F.coalesce(F.when(F.trim("source") != "", F.trim("source")), F.lit("unknown"))
    p = predictions(spark, d).withColumn("source", src)
    return p.rollup("source").agg(F.grouping("source").cast("int").alias("is_total"), F.count("*").alias("total"), F.sum("y").cast("long").alias("positives"), (F.count("*") - F.sum("y")).cast("long").alias("negatives"), F.round(100.0 * F.sum("y") / F.count("*"), 4).alias("pct"))


@query("A12_classification_metrics", f"WITH {PRED}, c AS (SELECT {_CM} FROM (SELECT y, (p >= 0.6)::INT AS h FROM pred)) SELECT {_closed()} FROM c")
def a12(spark, d):
    return M.classification_metrics(predictions(spark, d).withColumn("h", (F.col("p") >= 0.6).cast("int")), "y", "h")


_AUC = "SELECT {by} CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN 0.5 ELSE (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY {p}) + (count(*) OVER (PARTITION BY {part}, {p}) - 1) / 2.0 AS rk FROM {rel}) {group}"


@query("A13_roc_auc", f"WITH {PRED} " + _AUC.format(by="lang,", part="lang", p="p", rel="pred", group="GROUP BY lang"))
def a13(spark, d):
    return M.roc_auc(predictions(spark, d), "y", "p", ["lang"])


_CURVE = "cv AS (SELECT p AS threshold, sum(y) AS pos, count(*) - sum(y) AS neg FROM pred GROUP BY p), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM cv WINDOW w AS (ORDER BY threshold DESC))"


@query("A14_pr_auc", f"""WITH {PRED}, {_CURVE} SELECT sum(pos::DOUBLE / pa * (tp::DOUBLE / (tp + fp))) AS average_precision,
  sum(pos::DOUBLE / pa * ((tp::DOUBLE / (tp + fp)) + CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos)::DOUBLE / (tp + fp - pos - neg) ELSE 1 END) / 2) AS pr_trapezoid FROM cu""")
def a14(spark, d):
    return M.pr_auc(predictions(spark, d), "y", "p")


@query("A15_curve_points", f"WITH {PRED}, {_CURVE} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp::DOUBLE / pa AS tpr, fp::DOUBLE / na AS fpr, tp::DOUBLE / (tp + fp) AS precision FROM cu")
def a15(spark, d):
    return M.curve_points(predictions(spark, d), "y", "p").drop("pos", "neg", "pos_all")


@query("A16_brier", f"WITH {PRED} SELECT lang, avg((p - y) * (p - y)) AS brier FROM pred GROUP BY lang")
def a16(spark, d):
    return predictions(spark, d).groupBy("lang").agg(M.brier("y", "p").alias("brier"))


_BINS = """bn AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(y) AS accuracy, avg(p) AS confidence FROM pred GROUP BY 1),
  bi AS (SELECT r.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(accuracy, 0) AS accuracy, coalesce(confidence, 0) AS confidence, abs(coalesce(accuracy, 0) - coalesce(confidence, 0)) AS gap FROM range(10) r(bin) LEFT JOIN bn ON bn.bin = r.bin)"""


@query("A17_ece_bins", f"WITH {PRED}, {_BINS} SELECT * FROM bi")
def a17(spark, d):
    return M.calibration_bins(predictions(spark, d), "y", "p")


@query("A17_ece", f"WITH {PRED}, {_BINS} SELECT sum(n * gap) / sum(n) AS ece FROM bi")
def a17e(spark, d):
    return M.ece(M.calibration_bins(predictions(spark, d), "y", "p"))


@query("A18_log_loss", f"WITH {PRED} SELECT lang, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS log_loss FROM pred GROUP BY lang")
def a18(spark, d):
    return predictions(spark, d).groupBy("lang").agg(M.log_loss("y", "p").alias("log_loss"))


#: The thresholds that are swept.
SWEEP = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]
_SWEPT = lambda ts: f"sw AS (SELECT t AS threshold, {_CM} FROM (SELECT t, y, (p >= t)::INT AS h FROM pred, unnest([{', '.join(map(repr, ts))}]::DOUBLE[]) AS r(t)) GROUP BY t), c AS (SELECT * FROM sw)"


@query("A20_threshold_sweep", f"WITH {PRED}, {_SWEPT(SWEEP)} SELECT {_closed(4, 'threshold, ')} FROM c")
def a20(spark, d):
    return M.at_thresholds(predictions(spark, d), "y", "p", SWEEP, digits=4)


@query("A20_best_threshold", f"WITH {PRED}, {_SWEPT(SWEEP)}, m AS (SELECT {_closed(None, 'threshold, ')} FROM c) SELECT threshold AS best_threshold, f1 AS best_value FROM m ORDER BY f1 DESC, threshold LIMIT 1")
def a20b(spark, d):
    return M.best_threshold(M.at_thresholds(predictions(spark, d), "y", "p", SWEEP), F.col("f1"))


#: The thresholds that a data set's evaluation tries.
FEW = [0.2, 0.25, 0.3, 0.35, 0.4, 0.5]


@query("A20_threshold_sweep_dataset", f"WITH {PRED}, {_SWEPT(FEW)}, m AS (SELECT {_closed(None, 'threshold, ')} FROM c) SELECT threshold, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, threshold = (SELECT threshold FROM m ORDER BY f1 DESC, threshold LIMIT 1) AS best FROM m")
def a20d(spark, d):
    m = M.at_thresholds(predictions(spark, d), "y", "p", FEW)
    best = F.broadcast(M.best_threshold(m, F.col("f1")).select("best_threshold"))
    four = [F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    return m.crossJoin(best).select("threshold", *four, (F.col("threshold") == F.col("best_threshold")).alias("best"))  # best: one row


YOUDEN = [round(0.1 + i / 100, 2) for i in range(81)]


@query("A21_youden_threshold", f"WITH {PRED}, {_SWEPT(YOUDEN)}, m AS (SELECT {_closed(None, 'threshold, ')} FROM c) SELECT threshold AS best_threshold, recall + specificity - 1 AS best_value FROM m ORDER BY recall + specificity - 1 DESC, threshold LIMIT 1")
def a21(spark, d):
    return M.best_threshold(M.at_thresholds(predictions(spark, d), "y", "p", YOUDEN), F.col("recall") + F.col("specificity") - 1)


@query("A22_bootstrap_ci")
def a22(spark, d):
    return B.bootstrap_ci(predictions(spark, d), "y", "p", 0.6)


@query("A23_paired_bootstrap")
def a23(spark, d):
    return B.paired_bootstrap(predictions(spark, d), "y", "p", "p2")


@query("A24_mcnemar_counts", f"WITH {PRED}, r AS (SELECT count(*) FILTER (y = (p >= 0.6)::INT AND y <> (p2 >= 0.4)::INT) AS b, count(*) FILTER (y <> (p >= 0.6)::INT AND y = (p2 >= 0.4)::INT) AS c FROM pred) SELECT b, c, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0 END::DOUBLE AS statistic FROM r")
def a24c(spark, d):
    return a24(spark, d).drop("p_value")


@query("A24_mcnemar")
def a24(spark, d):
    p = predictions(spark, d)
    return M.mcnemar(p.withColumns({"a": (F.col("p") >= 0.6).cast("int"), "b": (F.col("p2") >= 0.4).cast("int")}), "y", "a", "b")


@query("A25_cohens_kappa", """WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM c),
  s AS (SELECT sum(na * nb)::DOUBLE AS both_ FROM (SELECT v, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb FROM (SELECT 'a' AS s, a AS v FROM c UNION ALL SELECT 'b', b FROM c) GROUP BY v))
  SELECT n, same::DOUBLE / n AS agreement, (same::DOUBLE / n - both_ / (n::DOUBLE * n)) / (1 - both_ / (n::DOUBLE * n)) AS kappa FROM t, s""")
def a25(spark, d):
    from .registry import table

    return M.cohens_kappa(table(spark, d, "labels"), "quality", "toxic")


@query("A29_latency_profile", f"""WITH {STAGES} SELECT stage, count(latency_ms) AS n, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.9) AS p90, quantile_cont(latency_ms, 0.95) AS p95,
  quantile_cont(latency_ms, 0.99) AS p99, max(latency_ms) AS max FROM stage_events GROUP BY stage""")
def a29(spark, d):
    return M.latency_profile(stage_events(spark, d), "latency_ms", ["stage"])


@query("A37_probability_diagnostics", f"WITH {PRED} SELECT lang, min(p) AS min, max(p) AS max, avg(p) AS mean, stddev_pop(p) AS std, count(DISTINCT round(p, 4)) AS n_distinct, count(*) FILTER (p >= 0.5) AS positives FROM pred GROUP BY lang")
def a37(spark, d):
    return predictions(spark, d).groupBy("lang").agg(F.min("p").alias("min"), F.max("p").alias("max"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.countDistinct(F.round("p", 4)).alias("n_distinct"), F.count_if(F.col("p") >= 0.5).alias("positives"))


_SPLIT = "CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 8 THEN 'validation' ELSE 'test' END"


@query("A39_split_counts", f"WITH {PRED} SELECT {_SPLIT} AS split, count(*) AS total, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives FROM pred GROUP BY 1")
def a39(spark, d):
    return predictions(spark, d).groupBy(F.expr(_SPLIT).alias("split")).agg(F.count("*").alias("total"), F.sum("y").cast("long").alias("positives"), (F.count("*") - F.sum("y")).cast("long").alias("negatives"))


@query("A28_claim_level_metrics", f"""WITH {PRED}, g AS (SELECT 'claim' AS grain, y, (p >= 0.6)::INT AS h FROM pred UNION ALL SELECT 'response', max(y), max((p >= 0.6)::INT) FROM pred GROUP BY id // 4),
  c AS (SELECT grain, {_CM} FROM g GROUP BY grain) SELECT {_closed(4, 'grain, ')} FROM c""")
def a28(spark, d):
    p = predictions(spark, d).select("id", "y", (F.col("p") >= 0.6).cast("int").alias("h"))
    response = p.groupBy(F.floor(F.col("id") / 4).alias("r")).agg(F.max("y").alias("y"), F.max("h").alias("h"))
    return M.classification_metrics(p.select(F.lit("claim").alias("grain"), "y", "h").unionByName(response.select(F.lit("response").alias("grain"), "y", "h")), "y", "h", ["grain"])


_LEFT_OPEN = "SELECT split, sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(accuracy - confidence) END) / sum(n) AS ece FROM (SELECT split, CASE WHEN p > 0 THEN ceil(p * 10) END AS bin, count(*) AS n, avg(y) AS accuracy, avg(p) AS confidence FROM q GROUP BY ALL) GROUP BY split"


@query("A42_split_evaluation", f"""WITH {PRED}, q AS (SELECT *, {_SPLIT} AS split FROM pred), au AS ({_AUC.format(by="split,", part="split", p="p", rel="q", group="GROUP BY split")}), au2 AS ({_AUC.format(by="split,", part="split", p="p2", rel="q", group="GROUP BY split")}), ec AS ({_LEFT_OPEN}),
  c AS (SELECT split, {_CM}, avg((p - y) * (p - y)) AS brier FROM (SELECT split, y, p, (p >= 0.6)::INT AS h FROM q) GROUP BY split) SELECT {_closed(4, 'split, brier, au.auroc, au2.auroc AS auroc_p2, ece, ')} FROM c JOIN au USING (split) JOIN au2 USING (split) JOIN ec USING (split)""")
def a42(spark, d):
    p = predictions(spark, d).withColumns({"split": F.expr(_SPLIT), "h": (F.col("p") >= 0.6).cast("int")})
    b = p.groupBy("split").agg(M.brier("y", "p").alias("brier"))
    member = M.roc_auc(p, "y", "p2", ["split"]).withColumnRenamed("auroc", "auroc_p2")
    return M.classification_metrics(p, "y", "h", ["split"]).join(b, "split").join(M.roc_auc(p, "y", "p", ["split"]), "split").join(member, "split").join(M.grouped_ece(p, "y", "p", ["split"]), "split")


@query("A42_split_intervals")
def a42i(spark, d):
    """Bootstrap intervals of every split's metrics."""
    return B.bootstrap_ci(predictions(spark, d).withColumn("split", F.expr(_SPLIT)), "y", "p", 0.6, by="split")


#: Eight configurations of an ablation: weight of the first model's probability.
CONFIGS = {"full": 0.5, "no_retrieval": 0.9, "no_verifier": 0.8, "no_internal": 0.0, "internal_only": 1.0, "light": 0.6, "heavy": 0.4, "blend_70": 0.7}
_CFG = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in CONFIGS.items())


@query("A31_ablation_matrix", f"""WITH {PRED}, cfg(config, w) AS (VALUES {_CFG}), c AS (SELECT config, {_CM} FROM (SELECT config, y, (w * p + (1 - w) * p2 >= 0.5)::INT AS h FROM pred, cfg) GROUP BY config),
  m AS (SELECT {_closed(4, 'config, ')} FROM c) SELECT m.*, round(m.f1 - b.f1, 4) AS f1_change FROM m, (SELECT f1 FROM m WHERE config = 'full') b""")
def a31(spark, d):
    p = predictions(spark, d)
    wide = p.select("id", "y", *[(F.lit(w) * F.col("p") + (1 - F.lit(w)) * F.col("p2")).alias(k) for k, w in CONFIGS.items()])
    long = wide.unpivot(["id", "y"], list(CONFIGS), "config", "q").withColumn("h", (F.col("q") >= 0.5).cast("int"))
    m = M.classification_metrics(long, "y", "h", ["config"])
    base = F.broadcast(m.where("config = 'full'").select(F.col("f1").alias("base")))
    return m.crossJoin(base).withColumn("f1_change", F.round(F.col("f1") - F.col("base"), 4)).drop("base")  # base: one row


ALPHAS = [i / 20 for i in range(21)]


@query("A32_fusion_weight_sweep", f"""WITH {PRED}, x AS (SELECT a AS alpha, y, round(a * p + (1 - a) * p2, 9) AS q FROM pred, unnest([{', '.join(map(repr, ALPHAS))}]::DOUBLE[]) AS r(a)) """ + _AUC.format(by="alpha,", part="alpha", p="q", rel="x", group="GROUP BY alpha"))
def a32(spark, d):
    a = F.explode(F.array(*[F.lit(x) for x in ALPHAS])).alias("alpha")
    x = predictions(spark, d).select("y", "p", "p2", a).withColumn("q", F.round(F.col("alpha") * F.col("p") + (1 - F.col("alpha")) * F.col("p2"), 9))
    return M.roc_auc(x, "y", "q", ["alpha"])


_FUSED = f"""x AS (SELECT a AS alpha, y, round(a * p + (1 - a) * p2, 9) AS q FROM pred, unnest([{', '.join(map(repr, ALPHAS))}]::DOUBLE[]) AS r(a)), au AS ({_AUC.format(by="alpha,", part="alpha", p="q", rel="x", group="GROUP BY alpha")})"""


@query("A32_best_fusion_weight", f"WITH {PRED}, {_FUSED} SELECT alpha AS best_alpha, round(auroc, 9) AS best_auroc FROM au ORDER BY round(auroc, 9) DESC, alpha LIMIT 1")
def a32b(spark, d):
    return M.best_weight(a32(spark, d).withColumn("auroc", F.round("auroc", 9)), "alpha", "auroc")


#: Weights of the internal score in the table of fusions.
WEIGHTS = [0.5, 0.6, 0.7, 0.8, 0.9]


@query("A32_fusion_weight_table", f"""WITH {PRED}, x AS (SELECT w AS weight, y, round(w * p + round(1 - w, 2) * p2, 9) AS q FROM pred, unnest([{', '.join(map(repr, WEIGHTS))}]::DOUBLE[]) AS r(w)), au AS ({_AUC.format(by="weight,", part="weight", p="q", rel="x", group="GROUP BY weight")}),
  c AS (SELECT weight, {_CM} FROM (SELECT weight, y, (q >= 0.5)::INT AS h FROM x) GROUP BY weight), m AS (SELECT {_closed(4, 'weight, ')} FROM c) SELECT weight, accuracy, f1, auroc FROM m JOIN au USING (weight)""")
def a32t(spark, d):
    w = F.explode(F.array(*[F.lit(x) for x in WEIGHTS])).alias("weight")
    x = predictions(spark, d).select("y", "p", "p2", w).withColumn("q", F.round(F.col("weight") * F.col("p") + F.round(1 - F.col("weight"), 2) * F.col("p2"), 9))
    m = M.classification_metrics(x.withColumn("h", (F.col("q") >= 0.5).cast("int")), "y", "h", ["weight"]).select("weight", "accuracy", "f1")
    return m.join(M.roc_auc(x, "y", "q", ["weight"]), "weight")


@query("A30_seed_summary", f"""WITH {PRED}, s AS (SELECT id % 5 AS seed, avg((y = (p >= 0.6)::INT)::INT) AS accuracy FROM pred GROUP BY 1)
  SELECT count(*) AS n_seeds, avg(accuracy) AS mean, stddev_samp(accuracy) AS std, stddev_pop(accuracy) AS std_pop FROM s""")
def a30(spark, d):
    s = predictions(spark, d).groupBy((F.col("id") % 5).alias("seed")).agg(F.avg((F.col("y") == (F.col("p") >= 0.6).cast("int")).cast("int")).alias("accuracy"))
    return s.agg(F.count("*").alias("n_seeds"), F.avg("accuracy").alias("mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std"), F.stddev_pop("accuracy").alias("std_pop"))


@query("A38_validation_gate", f"""WITH {PRED} SELECT id % 4 AS seed, count(*) AS n, count(*) FILTER (p < 0 OR p > 1 OR p IS NULL) AS bad_probability, count(*) FILTER (y NOT IN (0, 1)) AS bad_label, count(*) - count(DISTINCT id) AS repeated,
  count(*) FILTER (p >= 0.6 AND y = 0) AS fp, count(*) FILTER (p < 0.6 AND y = 1) AS fn FROM pred GROUP BY 1""")
def a38(spark, d):
    return predictions(spark, d).groupBy((F.col("id") % 4).alias("seed")).agg(
        F.count("*").alias("n"), F.count_if(F.expr("p < 0 OR p > 1 OR p IS NULL")).alias("bad_probability"), F.count_if(~F.col("y").isin(0, 1)).alias("bad_label"),
        (F.count("*") - F.countDistinct("id")).alias("repeated"), F.count_if(F.expr("p >= 0.6 AND y = 0")).alias("fp"), F.count_if(F.expr("p < 0.6 AND y = 1")).alias("fn"),
    )


@query("A27_error_category_stats", f"""WITH {PRED}, e AS (SELECT lang AS category, y, (p >= 0.6)::INT AS h FROM pred), cat(category) AS (VALUES ('en'), ('de'), ('es'), ('fr'), ('Unverifiable')),
  t AS (SELECT CASE WHEN category IN ('en', 'de', 'es', 'fr') THEN category ELSE 'Unverifiable' END AS category, {_CM}, count(*) AS total FROM e GROUP BY 1)
  SELECT category, coalesce(total, 0) AS total, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce({_R("tp", "tp+fn")}, 0) AS recall, coalesce({_R("tp", "tp+fp")}, 0) AS precision FROM cat LEFT JOIN t USING (category)""")
def a27(spark, d):
    known = ["en", "de", "es", "fr"]
    e = predictions(spark, d).select(F.when(F.col("lang").isin(known), F.col("lang")).otherwise("Unverifiable").alias("category"), "y", (F.col("p") >= 0.6).cast("int").alias("h"))
    c = M.confusion(e, "y", "h", ["category"]).withColumn("total", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    every = spark.createDataFrame([(k,) for k in [*known, "Unverifiable"]], "category string")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rate = lambda a, b: F.coalesce(M.ratio(F.col("tp"), F.col(a) + F.col(b)), F.lit(0.0))
    return every.join(c, "category", "left").select("category", z("total"), z("tp"), z("fn"), z("fp"), rate("tp", "fn").alias("recall"), rate("tp", "fp").alias("precision"))


@query("J13_paired_predictions", f"WITH {PRED}, a AS (SELECT id, y, p FROM pred WHERE id % 2 = 0 OR id % 3 = 0), b AS (SELECT id, p2 FROM pred WHERE id % 3 <> 1) SELECT a.id, a.y, a.p, b.p2 FROM a JOIN b USING (id)")
def j13(spark, d):
    p = predictions(spark, d)
    return p.where("id % 2 = 0 OR id % 3 = 0").select("id", "y", "p").join(p.where("id % 3 <> 1").select("id", "p2"), "id")
