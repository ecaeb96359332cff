"""Queries of features, calibrators, attributions and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import metrics as M
from .profiles import PROFILES, claims, pages, people
from .q_text import strip
from .registry import query, table
from .views import PRED, QA, predictions, qa_pairs

_NUM = lambda x: rf"list_filter(list_transform(regexp_extract_all({x}, '\b\d+(?:\.\d+)?\b'), lambda n: n::DOUBLE), lambda v: v NOT IN (1900, 2000))"
_SENT = lambda x: rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
_WORD = lambda x: rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"
_YEAR = lambda x: rf"list_distinct(regexp_extract_all({x}, '\b(?:19\d\d|20\d\d)\b'))"
_COVERED = rf"list_transform(list_filter(string_split_regex(response, '\s+'), lambda w: length(w) > 3), lambda w: lower(regexp_replace(w, '^[.,!?\"'']+|[.,!?\"'']+$', '', 'g')))"


def responses(spark, d):
    """claim_id, query, response, evidence, scores, similarity: claims with numbers, every seventh without evidence."""
    ppl = people(spark, d)
    by = pages(ppl).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "text", "score"))).alias("p"))
    c = claims(ppl).join(by, "k", "left")
    text = F.concat("text", F.lit(" It has "), (F.col("k") % 300 + 100).cast("string"), F.lit(" people since 1990."))
    sim = F.when(F.col("k") % 2 == 0, (F.col("k") % 10) / 10.0)
    return c.select("claim_id", F.concat(F.lit("How many people has "), "company", F.lit(" in 1990?")).alias("query"), text.alias("response"), F.transform("p", lambda x: x["text"]).alias("evidence"), F.transform("p", lambda x: x["score"]).alias("scores"), sim.alias("similarity"))


@query("M01_explicit_features", rf"""WITH {PROFILES}, ev AS (SELECT k, string_agg(text, ' ' ORDER BY n) AS e, max(score) AS mx, avg(score) AS av FROM ppg GROUP BY k),
  a AS (SELECT claim_id, 'How many people has ' || company || ' in 1990?' AS query, text || ' It has ' || (k % 300 + 100) || ' people since 1990.' AS response, e, mx, av, CASE WHEN k % 2 = 0 THEN (k % 10) / 10.0::DOUBLE END AS sim FROM pcl LEFT JOIN ev USING (k)),
  b AS (SELECT *, coalesce(e, query) AS ev, {_YEAR('response')} AS ry FROM a), c AS (SELECT *, {_YEAR('ev')} AS ey, {_COVERED} AS cw, {_SENT('response')} AS rs, list_filter({_SENT('ev')}, lambda s: len({_NUM('s')}) > 0) AS es FROM b),
  n AS (SELECT claim_id, i, rs[i] AS s, {_NUM('rs[i]')} AS own, es FROM c, unnest(range(1, len(rs) + 1)) AS r(i)), o AS (SELECT claim_id, i, own, s, j, es[j] AS e, len(list_intersect({_WORD('s')}, {_WORD('es[j]')})) AS hits FROM n, unnest(range(1, len(es) + 1)) AS r(j) WHERE len(own) > 0),
  p AS (SELECT claim_id, i, own, arg_max(e, (hits, -j)) AS e FROM o GROUP BY ALL), x AS (SELECT claim_id, unnest(own) AS v, {_NUM('e')} AS ys FROM p),
  f AS (SELECT claim_id, avg(list_min(list_transform(ys, lambda y: abs(v - y) / greatest(abs(v), abs(y), 1e-5)))) AS err FROM x GROUP BY claim_id)
  SELECT claim_id, round(coalesce(sim, 0.5), 4)::DOUBLE AS semantic_similarity, round(coalesce(mx, 0), 4) AS max_retrieval_confidence, round(coalesce(av, 0), 4) AS avg_retrieval_confidence, 0.5::DOUBLE AS entity_overlap_ratio,
    round(CASE WHEN len(ry) = 0 THEN 0.5 WHEN len(ey) > 0 THEN len(list_intersect(ry, ey))::DOUBLE / len(ry) ELSE 0 END, 4)::DOUBLE AS temporal_consistency_score, round(coalesce(err, 0), 4) AS numeric_relative_error, round(len(list_filter(cw, lambda w: contains(lower(ev), w)))::DOUBLE / len(cw), 4) AS citation_coverage_ratio,
    round(1 - coalesce(sim, 0.5), 4)::DOUBLE AS nli_contradiction_score, round(coalesce(sim, 0.5), 4)::DOUBLE AS nli_entailment_score, round(greatest(0, 1 - abs(coalesce(sim, 0.5) - 0.5) * 2), 4)::DOUBLE AS nli_neutral_score,
    (sim IS NOT NULL)::INT::DOUBLE AS semantic_available, 0.0::DOUBLE AS entity_available, (e IS NOT NULL)::INT::DOUBLE AS evidence_available, 0.0::DOUBLE AS nli_available, (err IS NOT NULL)::INT::DOUBLE AS numeric_available FROM c LEFT JOIN f USING (claim_id)""")
def m01(spark, d):
    return X.explicit_features(responses(spark, d)).select("claim_id", *X.NAMES)


@query("M02_check_feature_schema", f"SELECT 15 AS n_features, sha256('{','.join(f'{n}:double' for n in X.NAMES)}') AS digest")
def m02(spark, d):
    return X.schema_row(X.explicit_features(responses(spark, d)).select("claim_id", *X.NAMES))


@query("M11_calibrators")
def m11(spark, d):
    p = X.isotonic(X.calibrated(X.calibrated(predictions(spark, d), "y", ["p"], "platt"), "y", ["p", "p2"], "gated"), "y", "p")
    return p.select("id", "platt", "gated", "isotonic")


KS = [1, 3, 5]
_SPLITW = lambda c: rf"list_filter(string_split_regex(lower({c}), '\s+'), lambda x: x <> '')"


def qa_parts(spark, d):
    """id, parts: words of an answer, scored by whether its question has them."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    qa = qa_pairs(spark, d)
    return qa.select(F.col("response_id").alias("id"), X.ungrounded(words(F.col("response")), words(F.col("query"))).alias("parts"))


@query("A33_attribution_faithfulness", f"""WITH {QA}, t AS (SELECT response_id AS id, {_SPLITW('response')} AS ws, {_SPLITW('query')} AS q FROM qa), w AS (SELECT id, i, length(ws[i])::DOUBLE AS den, CASE WHEN list_contains(q, ws[i]) THEN 0 ELSE length(ws[i]) END::DOUBLE AS num FROM t, unnest(range(1, len(ws) + 1)) AS r(i)),
  s AS (SELECT *, sum(num) OVER (PARTITION BY id) AS n, sum(den) OVER (PARTITION BY id) AS d FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN d - den > 0 THEN (n - num) / (d - den) ELSE 0 END - n / d, i) AS rt, row_number() OVER (PARTITION BY id ORDER BY md5(id || ':' || i || ':42'), i) AS rr FROM s),
  x AS (SELECT id, k, any_value(n / d) AS original, coalesce(sum(num) FILTER (rt > k) / sum(den) FILTER (rt > k), 0) AS t, coalesce(sum(num) FILTER (rr > k) / sum(den) FILTER (rr > k), 0) AS r FROM o, unnest({KS}) AS u(k) GROUP BY ALL),
  e AS (SELECT * FROM x UNION ALL SELECT id, k, 0, 0, 0 FROM t, unnest({KS}) AS u(k) WHERE len(ws) = 0), g AS (SELECT k, avg(original - t) AS top_drop, avg(original - r) AS random_drop FROM e GROUP BY k)
  SELECT k, top_drop, random_drop, CASE WHEN random_drop >= 0 THEN top_drop / (random_drop + 1e-6) ELSE top_drop / 1e-6 END AS ratio, top_drop - random_drop AS gain FROM g""")
def a33(spark, d):
    return X.faithfulness_by_k(X.deletion_scores(qa_parts(spark, d), KS))


_MAPS = "m AS (SELECT id AS position, 1 AS seed, p AS v FROM pred UNION ALL SELECT id, 2, p2 FROM pred UNION ALL SELECT id, 3, (id % 7) / 7.0::DOUBLE FROM pred)"


@query("A34_attribution_consistency", f"WITH {PRED}, {_MAPS}, r AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY v) + (count(*) OVER (PARTITION BY seed, v) - 1) / 2.0 AS rk FROM m) SELECT a.seed AS seed_a, b.seed AS seed_b, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)) + 1e-8) AS cosine, corr(a.rk, b.rk) AS spearman FROM r a JOIN r b ON a.position = b.position AND a.seed < b.seed GROUP BY ALL")
def a34(spark, d):
    values = F.array(F.struct(F.lit(1).alias("seed"), F.col("p").alias("value")), F.struct(F.lit(2).alias("seed"), F.col("p2").alias("value")), F.struct(F.lit(3).alias("seed"), ((F.col("id") % 7) / 7.0).alias("value")))
    return X.attribution_consistency(predictions(spark, d).select(F.col("id").alias("position"), F.inline(values)))


@query("A35_evidence_sufficiency", f"WITH {PRED} SELECT avg(((p2 < 0.5)::INT = 1 - (p >= 0.6)::INT)::INT) AS sufficiency FROM pred")
def a35(spark, d):
    p = predictions(spark, d).select((F.col("p2") < 0.5).cast("int").alias("s"), (F.col("p") >= 0.6).cast("int").alias("h"))
    return X.evidence_sufficiency(p, "s", "h")


@query("M18_leakage_guards", f"""WITH {PRED}, oof AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'NaN'::DOUBLE ELSE p END AS p FROM pred WHERE id % 11 <> 0 UNION ALL SELECT id, p FROM pred WHERE id % 13 = 0 AND id % 11 <> 0),
  k AS (SELECT i.id, c FROM (SELECT DISTINCT id FROM pred) i LEFT JOIN (SELECT id, count(*) AS c FROM oof GROUP BY id) h ON h.id = i.id), s AS (SELECT count(*) FILTER (p IS NULL OR isnan(p) OR isinf(p)) AS not_finite, count(DISTINCT p) AS distinct_scores FROM oof)
  SELECT count(*) FILTER (c IS NULL) AS missing, count(*) FILTER (c > 1) AS repeated, any_value(not_finite) AS not_finite, any_value(distinct_scores) AS distinct_scores FROM k, s""")
def m18(spark, d):
    """Scores that lack some keys, have some twice, and are not numbers for some."""
    p = predictions(spark, d).select("id", "p")
    oof = p.where("id % 11 <> 0").withColumn("p", F.when(F.col("id") % 17 == 0, float("nan")).otherwise(F.col("p")))
    return X.oof_faults(oof.unionByName(p.where("id % 13 = 0 AND id % 11 <> 0")), p, "id", "p")


@query("J14_gold_join", "WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), g AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT g.source AS query_id, g.doc_id, rank FROM g LEFT JOIN (SELECT * FROM q WHERE rank <= 20) q ON q.source = g.source AND q.doc_id = g.doc_id")
def j14(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    gold = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("query_id", "doc_id")
    return M.gold_join(ranked, gold, 20)
