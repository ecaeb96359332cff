"""Queries of classifiers, calibration and baselines, and of lexical verdicts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import selection as E
from ..functions import text as T
from ..operators import metrics as M
from ..operators import ml
from ..operators import retrieval
from ..operators import scoring as S
from ..session import stored
from .q_text import _EV, SPLIT, claims_of, sql_jaccard, sql_overlap_words, strings, strip, with_evidence
from .registry import query, table
from .views import PRED, TEMPLATED, predictions


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), array_to_vector("embedding").alias("v"))


_STACKS: dict[tuple[str, str], ml.Stack] = {}


def _stack(spark, d) -> ml.Stack:
    """The stack over the vectors, fitted once for a session and folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _STACKS:
        _STACKS[at] = ml.Stack("vec_id", trees=50, rounds=20).fit(_vectors(spark, d), "y", "v")
    return _STACKS[at]


@query("M08_oof_stacking")
def m08(spark, d):
    return _stack(spark, d).oof


@query("M09_predict_ensemble")
def m09(spark, d):
    return _stack(spark, d).predict(_vectors(spark, d), "v").select("vec_id", "y", *ml.MEMBERS, "stacked", "calibrated", "predicted")


@query("M13_compare_systems")
def m13(spark, d):
    """AUROC and F1 of the same folds and members over slices of the vectors."""
    slices = {"A": list(range(32)), "B": [32, 33, 34], "C": list(range(35, 50)), "D": list(range(64))}
    c = stored(ml.compare_systems(_vectors(spark, d), "vec_id", "y", "v", slices, trees=20), "systems")
    return M.roc_auc(c, "label", "calibrated", ["system"]).join(M.classification_metrics(c, "label", "predicted", ["system"]).select("system", "f1", "accuracy"), "system")


@query("M14_fitted_probes")
def m14_fitted(spark, d):
    return ml.probes(_vectors(spark, d), "vec_id", "y", "v", 32).drop("label")


def _grid(low: str, high: str) -> str:
    return f"list_transform(range({ml.POINTS}), lambda i: ({low}) * pow(({high}) / ({low}), i / {ml.POINTS - 1}.0::DOUBLE))"


def _rounds() -> str:
    """Each round's points, losses and bounds, as the operator narrows them."""
    out = [f"g0 AS (SELECT {_grid(*(f'{x}::DOUBLE' for x in ml.TEMPERATURES))} AS ts)"]
    for r in range(ml.REFINED):
        out.append(f"l{r} AS (SELECT i, t, (SELECT sum(-(pos * ln(s) + neg * ln(1 - s))) / sum(pos + neg) FROM (SELECT pos, neg, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-z / t)))) AS s FROM zc)) AS nll FROM (SELECT unnest(ts) AS t, unnest(range(1, {ml.POINTS + 1})) AS i FROM g{r}))")
        out.append(f"b{r} AS (SELECT t, nll, i FROM l{r} ORDER BY nll, t LIMIT 1)")
        out.append(f"g{r + 1} AS (SELECT {_grid('lo', 'hi')} AS ts FROM (SELECT ts[greatest(i - 1, 1)] AS lo, ts[least(i + 1, {ml.POINTS})] AS hi FROM g{r}, b{r}))")
    return ", ".join(out)


@query("M12_temperature_scaling", f"""WITH {PRED}, zc AS (SELECT ln(q / (1 - q)) AS z, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM (SELECT y, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM pred) GROUP BY 1), {_rounds()}
  SELECT round(temperature, 5) AS temperature, round(nll, 9) AS nll FROM (SELECT t AS temperature, nll FROM (""" + " UNION ALL ".join(f"SELECT * FROM b{r}" for r in range(ml.REFINED)) + """) ORDER BY nll, t LIMIT 1)""")
def m12(spark, d):
    return ml.temperature_scaling(predictions(spark, d), "y", "p").select(F.round("temperature", 5).alias("temperature"), F.round("nll", 9).alias("nll"))


_BASE = r"""b AS (SELECT doc_id, y, w, q, ('0x' || substr(md5(doc_id || ':baseline'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS uniform, len(list_distinct(w))::DOUBLE / len(w) AS unique_words,
  len(list_intersect(w, q))::DOUBLE / len(list_distinct(q)) AS query_overlap, (length(text) % 100) / 100.0::DOUBLE AS length FROM (SELECT doc_id, quality AS y, text, string_split_regex(lower(text), '\s+') AS w, string_split_regex(lower(source || ' the and'), '\s+') AS q FROM documents JOIN labels USING (doc_id)))"""


def _baselines(spark, d):
    labels = table(spark, d, "labels")
    share = F.broadcast(labels.join(table(spark, d, "documents").select("doc_id"), "doc_id").agg(F.avg("quality").alias("share")))
    j = table(spark, d, "documents").join(labels, "doc_id").crossJoin(share)  # one row
    cols = ml.baselines(F.col("text"), F.concat("source", F.lit(" the and")), F.col("doc_id"), F.col("share"))
    return j.select("doc_id", F.col("quality").alias("y"), *[c.alias(n) for n, c in cols.items()])


@query("M14_baselines", f"WITH {_BASE} SELECT doc_id, y, (avg(y) OVER () >= 0.5)::INT::DOUBLE AS majority, uniform, unique_words, query_overlap, length, 0.4 * unique_words + 0.6 * length AS blend FROM b")
def m14(spark, d):
    return _baselines(spark, d)


_NAMES = ["majority", "uniform", "unique_words", "query_overlap", "length", "blend"]
_RATE = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


@query("M15_baseline_table", f"""WITH {_BASE}, w AS (SELECT doc_id, y, (avg(y) OVER () >= 0.5)::INT::DOUBLE AS majority, uniform, unique_words, query_overlap, length, 0.4 * unique_words + 0.6 * length AS blend FROM b),
  l AS (UNPIVOT w ON {', '.join(_NAMES)} INTO NAME baseline VALUE p), c AS (SELECT baseline, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1) AS pa FROM l GROUP BY baseline),
  r AS (SELECT *, rank() OVER (PARTITION BY baseline ORDER BY p) + (count(*) OVER (PARTITION BY baseline, p) - 1) / 2.0 AS rk FROM l), au AS (SELECT baseline, CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN 0.5 ELSE (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc FROM r GROUP BY baseline),
  s AS (SELECT baseline, p, sum(y) AS pos, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT baseline, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (PARTITION BY baseline ORDER BY p DESC)), ap AS (SELECT baseline, sum(pos * (tp::DOUBLE / n)) / sum(pos) AS average_precision FROM t GROUP BY baseline)
  SELECT baseline, round({_RATE('2 * tp', '2 * tp + fp + fn')}, 4) AS f1, round({_RATE('tp', 'tp + fp')}, 4) AS precision, round({_RATE('tp', 'pa')}, 4) AS recall, auroc, average_precision FROM c JOIN au USING (baseline) JOIN ap USING (baseline)""")
def m15(spark, d):
    b = _baselines(spark, d)
    long = b.unpivot(["doc_id", "y"], _NAMES, "baseline", "p").withColumn("h", (F.col("p") >= 0.5).cast("int"))
    m = M.classification_metrics(long, "y", "h", ["baseline"]).select("baseline", "f1", "precision", "recall")
    return m.join(M.roc_auc(long, "y", "p", ["baseline"]), "baseline").join(M.pr_auc(long, "y", "p", ["baseline"]).select("baseline", "average_precision"), "baseline")


#: Named groups of the vectors' dimensions.
GROUPS = {"internal": range(0, 32), "scores": range(32, 48), "evidence": range(48, 64)}


@query("M16_feature_importance_share")
def m16(spark, d):
    """Share of the forest's importance by group, and each group's features among the ten most important."""
    return ml.importance_shares(spark, _stack(spark, d).members["rf"].featureImportances.toArray(), GROUPS)


_LONG = rf"list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 3), lambda w: lower(regexp_replace(w, '^[.,!?\"'']+|[.,!?\"'']+$', '', 'g')))"
_PRED = f"list_filter({strings(L.PREDICATES)}, lambda p: contains(lower(text), p))"
_SCORES = f"list_transform(list_filter(list_transform({SPLIT['mark']('top')}, lambda s: {strip('s')}), lambda s: length(s) > 15), lambda s: round(least(1.0::DOUBLE, {sql_jaccard(sql_overlap_words('text'), sql_overlap_words('s'))} + CASE WHEN len(list_filter({_PRED}, lambda p: contains(lower(s), p))) > 0 THEN 0.35 ELSE 0 END), 4))"


@query("V14_lexical_fallback_verdict", f"WITH {TEMPLATED}, {_EV}, a AS (SELECT claim_id, text, coalesce(texts[1], '') AS top FROM ce), b AS (SELECT *, CASE WHEN top = '' THEN 0 ELSE coalesce(list_max({_SCORES}), 0.5) END::DOUBLE AS best, {_LONG} AS lw FROM a), c AS (SELECT *, CASE WHEN len(lw) > 0 THEN len(list_filter(lw, lambda w: contains(lower(top), w)))::DOUBLE / len(lw) ELSE 0 END AS hit FROM b) SELECT claim_id, CASE WHEN best >= 0.30 OR hit >= 0.50 THEN 'supported' WHEN hit > 0 THEN 'partial' ELSE 'contradicted' END AS verdict, CASE WHEN best >= 0.30 OR hit >= 0.50 THEN round(least(0.95, 0.70 + best), 2) WHEN hit > 0 THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence FROM c")
def v14(spark, d):
    c = with_evidence(spark, d).withColumn("top", F.coalesce(F.get("texts", F.lit(0)), F.lit("")))
    v = R.lexical_verdict(E.best_sentence_score(F.col("text"), F.col("top")), R.word_match(F.col("text"), F.col("top")))
    return c.select("claim_id", v.alias("v")).select("claim_id", "v.*")


@query("flagship_answer_scores")
def flagship(spark, d):
    """Answers to claims, evidence from the documents, the best sentence of each, verdicts, and a score for each answer."""
    claims = stored(claims_of(spark, d).withColumn("claim_id", F.concat_ws("#", "response_id", "pos")), "claims")  # read four times below
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "text")
    found = stored(retrieval.lexical_retrieve(claims.select("claim_id", F.col("claim").alias("text")), docs, prose=True).select("claim_id", "fact_id"), "found")
    support = retrieval.document_support(found, claims.select("claim_id", F.col("claim").alias("text")), docs)
    v = R.lexical_verdict(F.coalesce("best", F.lit(0.0)), F.coalesce("match", F.lit(0.0)))
    judged = claims.join(support, "claim_id", "left").select("claim_id", "response_id", v.alias("v"), F.lit(False).alias("fabricated")).select("response_id", "v.*", "fabricated")
    return S.hallucination_score(judged, claims.select("response_id").distinct())
