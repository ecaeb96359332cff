"""Queries of retrieval, ranking, sampling, set operations, history and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import sampling as S
from ..streaming import telemetry as E
from .q_text import SPLIT, sql_jaccard, sql_overlap_words, strip, strings
from ..session import scratch
from .registry import SQL, query, table
from .views import PRED, QA, STAGES, TEMPLATED, as_stages, predictions, qa_pairs, stage_events, templated, templated_rows

_TOK = r"list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))"
_J01 = f"a AS (SELECT item_id AS claim_id, unnest({_TOK}) AS w FROM benchmark), b AS (SELECT doc_id AS fact_id, unnest({_TOK}) AS w FROM documents), j01 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, fact_id) AS rank FROM (SELECT claim_id, fact_id, count(*) AS score FROM a JOIN b USING (w) GROUP BY ALL)) WHERE rank <= 3)"


def _j01(spark, d):
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return R.lexical_retrieve(claims, table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "text"))


query("J01_lexical_retrieve", f"WITH {_J01} SELECT claim_id, fact_id, score, rank FROM j01")(_j01)

_J02 = "j02 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT x.vec_id AS query_id, y.vec_id, list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0)) WHERE rank <= 5)"


def _j02(spark, d):
    e = table(spark, d, "embeddings")
    return R.dense_retrieve(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")))


query("J02_dense_retrieve", f"WITH {_J02} SELECT query_id, vec_id, round(score, 9) AS score, rank FROM j02")(lambda s, d: _j02(s, d).withColumn("score", F.round("score", 9)))


@query("A19_retrieval_metrics", f"""WITH {_J02}, gold AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0),
  h AS (SELECT g.query_id, g.doc_id, j.rank FROM gold g LEFT JOIN j02 j ON j.query_id = g.query_id AND j.vec_id = g.doc_id), p AS (SELECT query_id, count(*) AS n_gold, count(rank) AS n_hit, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM h GROUP BY query_id)
  SELECT count(*) AS n_queries, avg(n_hit::DOUBLE / n_gold) AS recall, avg(coalesce(1.0 / first, 0)) AS mrr, avg(dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg FROM p""")
def a19(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return M.class_retrieval_metrics(_j02(spark, d).withColumnRenamed("vec_id", "doc_id"), asked, e.select(F.col("vec_id").alias("doc_id"), "label"), 5)


@query("J05_alias_join", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Company ' || s_suppkey ELSE s_name END AS title FROM supplier")
def j05(spark, d):
    s = table(spark, d, "supplier")
    aliases = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("alias"), F.concat(F.lit("Company "), "s_suppkey").alias("title"))
    return R.alias_join(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), aliases)


@query("J06_provider_merge", f"""WITH {TEMPLATED}, u AS (SELECT 0 AS provider, * FROM evidence WHERE source = 'FEVER' AND score >= 0.5 UNION ALL SELECT 1, * FROM evidence WHERE source = 'Wikipedia'), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY provider, pos) AS n FROM u)
  SELECT claim_id, provider, pos, n FROM r WHERE n <= 1""")
def j06(spark, d):
    claims, ev = templated(spark, d)
    of = lambda cond: lambda c, k: ev.where(cond).join(c.select("claim_id"), "claim_id")
    return R.provider_merge(claims, [of("source = 'FEVER' AND score >= 0.5"), of("source = 'Wikipedia'")], 1).select("claim_id", "provider", "pos", "n")


@query("J07_evidence_fallback", f"""WITH {TEMPLATED}, h AS (SELECT DISTINCT claim_id AS c FROM evidence), j AS (SELECT claims.*, c FROM claims LEFT JOIN h ON c = claim_id)
  SELECT claim_id, response_id, coalesce(c, first_value(c IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY pos, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS source_claim FROM j""")
def j07(spark, d):
    claims, ev = templated(spark, d)
    return R.evidence_fallback(claims, ev)


_NODE = f"nd AS (SELECT claim_id, pos * 3 + i - 1 AS node, {sql_overlap_words('s')} AS w, regexp_matches(s, '(?i)\\b(not|no|never)\\b') AS neg FROM (SELECT claim_id, pos, i, ss[i] AS s FROM (SELECT claim_id, pos, list_filter(list_transform({SPLIT['mark']('text')}, lambda s: {strip('s')}), lambda s: length(s) > 15)[1:3] AS ss FROM evidence), unnest(range(1, len(ss) + 1)) AS r(i)))"
_EDGE = f"ed AS (SELECT claim_id, src, dst, relation, CASE relation WHEN 'redundant' THEN 0.90 WHEN 'contradict' THEN -0.85 ELSE 0.80 END::DOUBLE AS weight FROM (SELECT a.claim_id, a.node AS src, b.node AS dst, CASE WHEN {sql_jaccard('a.w', 'b.w')} > 0.7 THEN 'redundant' WHEN {sql_jaccard('a.w', 'b.w')} > 0.3 AND a.neg <> b.neg THEN 'contradict' WHEN {sql_jaccard('a.w', 'b.w')} > 0.3 THEN 'support' END AS relation FROM nd a JOIN nd b ON a.claim_id = b.claim_id AND a.node < b.node) WHERE relation IS NOT NULL)"
_PAIRS = TEMPLATED.replace("evidence AS (", "evidence0 AS (", 1) + ", evidence AS (SELECT claim_id, pos, CASE WHEN pos = 1 THEN (SELECT any_value(fact) FROM trows t WHERE t.claim_id = evidence0.claim_id) ELSE text END AS text, source, score FROM evidence0)"


def _paired(spark, d):
    """Evidence whose second item says the same as the first, so that edges arise."""
    claims, ev = templated(spark, d)
    fact = ev.where("pos = 0").select("claim_id", F.col("text").alias("fact"))
    return claims, ev.join(fact, "claim_id").withColumn("text", F.when(F.col("pos") == 1, F.col("fact")).otherwise(F.col("text"))).drop("fact")


@query("J09_evidence_pair_graph", f"WITH {_PAIRS}, {_NODE}, {_EDGE} SELECT * FROM ed")
def j09(spark, d):
    return R.pair_graph(_paired(spark, d)[1])


@query("A08_graph_consensus", f"WITH {_PAIRS}, {_NODE}, {_EDGE}, g AS (SELECT claim_id, sum(greatest(weight, 0)) / sum(abs(weight)) AS v FROM ed GROUP BY claim_id), h AS (SELECT DISTINCT claim_id FROM evidence) SELECT c.claim_id, coalesce(g.v, CASE WHEN h.claim_id IS NOT NULL THEN 0.75 ELSE 0.5 END)::DOUBLE AS consensus FROM claims c LEFT JOIN g USING (claim_id) LEFT JOIN h ON h.claim_id = c.claim_id")
def a08(spark, d):
    claims, ev = _paired(spark, d)
    return R.graph_consensus(claims, ev, R.pair_graph(ev))


_HASP = f"list_filter({strings(L.PREDICATES)}, lambda p: contains(lower(claim), p))"


@query("W05_rank_sentences", f"""WITH {QA}, s AS (SELECT response_id AS id, query AS claim, response AS passage, list_filter(list_transform({SPLIT['mark']('response')}, lambda s: {strip('s')}), lambda s: length(s) > 15) AS ss FROM qa),
  e AS (SELECT id, claim, len(ss) = 0 AS bare, i AS pos, CASE WHEN len(ss) = 0 THEN passage[1:200] ELSE ss[i] END AS sentence FROM s, unnest(range(1, greatest(len(ss), 1) + 1)) AS r(i)),
  f AS (SELECT *, CASE WHEN bare THEN 0.5 ELSE round(least(1.0, {sql_jaccard(sql_overlap_words('claim'), sql_overlap_words('sentence'))} + CASE WHEN len(list_filter({_HASP}, lambda p: contains(lower(sentence), p))) > 0 THEN 0.35 ELSE 0 END), 4) END AS score FROM e)
  SELECT id, rank, md5(sentence) AS digest, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM f) WHERE rank <= 2""")
def w05(spark, d):
    p = qa_pairs(spark, d).select(F.col("response_id").alias("id"), F.col("query").alias("claim"), F.col("response").alias("passage"))
    return R.rank_sentences(p).select("id", "rank", F.md5("sentence").alias("digest"), "score")


#: Five items a claim: two that nearly agree on fact and record, two that nearly agree on the record alone, and the fact; one is short.
_VARIED = TEMPLATED.split("claims AS (")[0].rstrip().rstrip(",") + """,
vr AS (SELECT claim_id, k, fact, 'Record ' || k || ' lists a warehouse and a carrier' AS rec FROM trows WHERE k % 7 <> 0),
vi AS (SELECT claim_id, unnest([{'pos': 0, 'text': fact || ' ' || rec || '.', 'score': (k % 11) / 11.0::DOUBLE}, {'pos': 1, 'text': fact || ' ' || rec || '. Again.', 'score': (k % 10) / 10.0::DOUBLE}, {'pos': 2, 'text': rec || ' now.', 'score': (k % 9) / 9.0::DOUBLE},
  {'pos': 3, 'text': rec || ' now. Again.', 'score': CASE WHEN k % 4 > 0 THEN (k % 8) / 8.0::DOUBLE END}, {'pos': 4, 'text': CASE WHEN k % 3 = 0 THEN 'Too short.' ELSE fact END, 'score': 0.5::DOUBLE}]) AS i FROM vr), evidence AS (SELECT claim_id, i.pos AS pos, i.text AS text, i.score AS score FROM vi)"""


def _varied(spark, d):
    k, fact = F.col("k"), F.col("fact")
    rec = F.concat(F.lit("Record "), "k", F.lit(" lists a warehouse and a carrier"))
    score = lambda n: ((k % n) / float(n)).cast("double")
    item = lambda pos, text, s: F.struct(F.lit(pos).alias("pos"), text.alias("text"), s.alias("score"))
    items = F.array(
        item(0, F.concat(fact, F.lit(" "), rec, F.lit(".")), score(11)), item(1, F.concat(fact, F.lit(" "), rec, F.lit(". Again.")), score(10)), item(2, F.concat(rec, F.lit(" now.")), score(9)),
        item(3, F.concat(rec, F.lit(" now. Again.")), F.when(k % 4 > 0, score(8))), item(4, F.when(k % 3 == 0, F.lit("Too short.")).otherwise(fact), F.lit(0.5)),
    )
    rows = templated_rows(spark, d).where("k % 7 <> 0")
    return rows.select("claim_id", F.explode(items).alias("e")).select("claim_id", "e.*")


_LIKE = lambda a, b: f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) >= 0.85"
_ROUND = lambda n: f"b{n} AS (SELECT claim_id, pos, w FROM l{n} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, pos) = 1), l{n + 1} AS (SELECT l.* FROM l{n} l JOIN b{n} b USING (claim_id) WHERE NOT ({_LIKE('l.w', 'b.w')}))"


@query("W09_dedup_near_duplicates", rf"WITH {_VARIED}, l1 AS (SELECT claim_id, pos, coalesce(score, 0) AS score, list_distinct(string_split_regex(lower(text), '\s+')) AS w FROM evidence), {', '.join(map(_ROUND, (1, 2, 3)))} SELECT claim_id, 1 AS n, pos FROM b1 UNION ALL SELECT claim_id, 2, pos FROM b2 UNION ALL SELECT claim_id, 3, pos FROM b3")
def w09(spark, d):
    return R.dedup_near(_varied(spark, d).withColumn("score", F.coalesce("score", F.lit(0.0))))


@query("F01_filter_evidence_quality", f"""WITH {_VARIED}, g AS (SELECT claim_id, pos, length(text) >= 20 AND coalesce(score, 0.5) >= 0.15 AS good, lower(text[1:100]) AS key FROM evidence), s AS (SELECT *, good AND row_number() OVER (PARTITION BY claim_id, good, key ORDER BY pos) = 1 AS stays FROM g)
  SELECT claim_id, pos FROM s QUALIFY stays OR (NOT bool_or(stays) OVER (PARTITION BY claim_id) AND row_number() OVER (PARTITION BY claim_id ORDER BY pos) = 1)""")
def f01(spark, d):
    return R.filter_quality(_varied(spark, d)).select("claim_id", "pos")


@query("F02_drop_disambiguation", "WITH p AS (SELECT page_id // 5 AS claim_id, page_id AS pos, CASE WHEN page_id % 3 = 0 THEN 'X may refer to several things' ELSE url END AS text FROM pages), f AS (SELECT *, regexp_matches(lower(text), 'disambiguation|may refer to') AS f FROM p) SELECT claim_id, pos FROM (SELECT *, bool_or(NOT f) OVER (PARTITION BY claim_id) AS o FROM f) WHERE NOT f OR NOT o")
def f02(spark, d):
    p = table(spark, d, "pages").select(F.floor(F.col("page_id") / 5).alias("claim_id"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 == 0, "X may refer to several things").otherwise(F.col("url")).alias("text"))
    return R.drop_disambiguation(p).select("claim_id", "pos")


# --- sets, samples, splits ------------------------------------------------------------------------------------------
_DEVTEST = f"{QA}, dev AS (SELECT * FROM qa WHERE md5(response_id) < '9'), tst AS (SELECT * FROM qa WHERE md5(response_id) > '7')"


def _devtest(spark, d):
    p = qa_pairs(spark, d)
    return p.where(F.md5("response_id") < "9"), p.where(F.md5("response_id") > "7")


@query("J12_contamination_check", f"WITH {_DEVTEST} SELECT md5(q) AS q, md5(r) AS r FROM (SELECT lower(trim(query)) AS q, lower(trim(response)) AS r FROM dev INTERSECT SELECT lower(trim(query)), lower(trim(response)) FROM tst)")
def j12(spark, d):
    return S.contaminated(*_devtest(spark, d)).select(F.md5("q").alias("q"), F.md5("r").alias("r"))


@query("U01_union_examples", f"WITH {QA}, u AS (SELECT 'qa' AS source, response_id AS id, NULL::INT AS label FROM qa UNION ALL SELECT 'labels', doc_id::VARCHAR, quality::INT FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM u) SELECT source, id, label FROM r WHERE n <= 2000")
def u01(spark, d):
    a = qa_pairs(spark, d).select(F.lit("qa").alias("source"), F.col("response_id").alias("id"))
    b = table(spark, d, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int").alias("label"))
    w = Window.partitionBy("source").orderBy("id")
    return a.unionByName(b, allowMissingColumns=True).withColumn("n", F.row_number().over(w)).where("n <= 2000").select("source", "id", "label")


@query("U02_intersect_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u02(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("U03_missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u03(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("U04_union_evidence", f"WITH {TEMPLATED} SELECT claim_id, count(*) AS n_items FROM (SELECT claim_id, pos FROM evidence WHERE source = 'Wikipedia' UNION ALL SELECT claim_id, pos FROM evidence WHERE source = 'FEVER') GROUP BY claim_id")
def u04(spark, d):
    e = templated(spark, d)[1]
    return e.where("source = 'Wikipedia'").unionByName(e.where("source = 'FEVER'")).groupBy("claim_id").agg(F.count("*").alias("n_items"))


@query("J15_coverage_check", "WITH c AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS found, trim(d.text) = '' AS blank FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT count(*) AS total, count(*) FILTER (found AND NOT blank) AS covered, count(*) FILTER (found AND blank) AS empty, count(*) FILTER (NOT found) AS missing FROM c")
def j15(spark, d):
    c = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    found, blank = F.coalesce("found", F.lit(False)), F.trim("text") == ""
    return c.agg(F.count("*").alias("total"), F.count_if(found & ~blank).alias("covered"), F.count_if(found & blank).alias("empty"), F.count_if(~found).alias("missing"))


@query("J16_history_join", "SELECT o_orderkey AS result_id, c_name AS job, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 5")
def j16(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("result_id"), F.col("c_name").alias("job"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), F.desc("result_id")).offset(5).limit(20)


@query("J18_result_with_claims", f"WITH {TEMPLATED} SELECT response_id, count(*) AS n_claims, string_agg(text, '|' ORDER BY pos, claim_id) AS claims FROM claims GROUP BY response_id")
def j18(spark, d):
    row = F.struct("pos", "claim_id", "text")
    return templated(spark, d)[0].groupBy("response_id").agg(F.count("*").alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]), "|").alias("claims"))


_DRAW = lambda k, s: f"md5({k}::VARCHAR || ':{s}')"


@query("M03_stratified_sample", f"WITH {PRED}, r AS (SELECT id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {_DRAW('id', 42)}, id) AS r, count(*) OVER () AS total FROM pred) SELECT id, source FROM r ORDER BY (r > round(n * 100.0::DOUBLE / total))::INT, {_DRAW('id', 42)}, id LIMIT 100")
def m03(spark, d):
    return S.stratified_sample(predictions(spark, d).select("id", "source"), "id", "source", 100)


@query("M04_train_val_test_split", f"WITH {PRED}, r AS (SELECT id, y, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY {_DRAW('id', 42)}, id) AS r FROM pred) SELECT id, y, CASE WHEN r <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r")
def m04(spark, d):
    return S.train_val_test(predictions(spark, d).select("id", "y"), "id", "y")


@query("M05_balanced_sample", f"WITH {PRED} SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_DRAW('id', 42)}, id) AS r FROM pred) WHERE r <= 40")
def m05(spark, d):
    return S.balanced_sample(predictions(spark, d).select("id", "y"), "id", "y", 80)


@query("M06_stratified_kfold", f"WITH {PRED} SELECT id, y, ((row_number() OVER (PARTITION BY y ORDER BY {_DRAW('id', 42)}, id) - 1) % 5)::INT AS fold FROM pred")
def m06(spark, d):
    return S.stratified_kfold(predictions(spark, d).select("id", "y"), "id", "y")


#: Rows of each error class in the sample.
QUOTAS = {"en": 25, "de": 25, "es": 20, "fr": 15}


@query("M07_error_sample", f"WITH {PRED} SELECT id, lang FROM (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW('id', 42)}, id) AS r FROM pred WHERE y <> (p >= 0.6)::INT) WHERE r <= CASE lang WHEN 'en' THEN 25 WHEN 'de' THEN 25 WHEN 'es' THEN 20 WHEN 'fr' THEN 15 END")
def m07(spark, d):
    wrong = predictions(spark, d).where(F.col("y") != (F.col("p") >= 0.6).cast("int")).select("id", "lang")
    return S.quota_sample(wrong, "id", "lang", QUOTAS)


@query("M10_internal_confidence", f"WITH {PRED} SELECT id, 0.5 * (1 - stddev) + 0.5 * abs(p + p2 - 1) AS confidence FROM (SELECT *, abs(p - p2) / 2 AS stddev FROM pred)")
def m10(spark, d):
    return predictions(spark, d).select("id", (0.5 * (1 - F.abs(F.col("p") - F.col("p2")) / 2) + 0.5 * F.abs(F.col("p") + F.col("p2") - 1)).alias("confidence"))


# --- windows over claims and jobs --------------------------------------------------------------------------------------
@query("W01_coref_resolve", f"WITH {TEMPLATED}, s AS (SELECT *, CASE WHEN pos % 4 = 0 THEN split_part(text, ' is ', 1) END AS subject FROM claims WHERE kind = 'location'), f AS (SELECT *, last_value(subject IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s) SELECT claim_id, CASE WHEN pos % 4 = 0 THEN text WHEN prev IS NULL THEN 'It' || substr(text, length(split_part(text, ' is ', 1)) + 1) ELSE prev || substr(text, length(split_part(text, ' is ', 1)) + 1) END AS resolved FROM f")
def w01(spark, d):
    from ..operators.claims import resolve_references

    c = templated(spark, d)[0].where("kind = 'location'")
    name = F.split("text", " is ")[0]
    said = c.withColumns({"subject": F.when(F.col("pos") == 0, name), "claim": F.when(F.col("pos") == 0, F.col("text")).otherwise(F.concat(F.lit("It"), F.expr("substr(text, length(split(text, ' is ')[0]) + 1)")))})
    return resolve_references(said).select("claim_id", "resolved")


@query("W10_ordered_distinct", f"WITH {QA}, w AS (SELECT response_id, i, ws[i] AS w FROM (SELECT response_id, string_split(lower(query), ' ') AS ws FROM qa), unnest(range(1, len(ws) + 1)) AS r(i)) SELECT response_id, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM (SELECT response_id, w, min(i) AS i FROM w GROUP BY ALL) GROUP BY response_id")
def w10(spark, d):
    return qa_pairs(spark, d).select("response_id", F.md5(F.array_join(F.array_distinct(F.split(F.lower("query"), " ")), " ")).alias("digest"))


@query("W12_latest_stage", f"WITH {STAGES} SELECT job_id, arg_max(stage, (ts, event_id)) AS stage, count(*) AS n_events FROM stage_events GROUP BY job_id")
def w12(spark, d):
    return stage_events(spark, d).groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("n_events"))


@query("W15_dominant_model", f"WITH {PRED} SELECT id, CASE WHEN p >= p2 THEN 'p' ELSE 'p2' END AS dominant, 1 - 2 * abs(p - p2) / 2 AS agreement FROM pred")
def w15(spark, d):
    long = predictions(spark, d).select("id", "p", "p2").unpivot("id", ["p", "p2"], "model", "v")
    return long.groupBy("id").agg(F.max_by("model", F.struct("v", F.when(F.col("model") == "p", 1).otherwise(0))).alias("dominant"), (1 - 2 * F.stddev_pop("v")).alias("agreement"))


@query("W16_execution_timeline", f"WITH {STAGES} SELECT job_id, md5(string_agg(stage, '>' ORDER BY ts, event_id)) AS timeline FROM stage_events GROUP BY job_id")
def w16(spark, d):
    row = F.struct("ts", "event_id", "stage")
    return stage_events(spark, d).groupBy("job_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["stage"]), ">")).alias("timeline"))


@query("W17_top_k_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def w17(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(10)


@query("S18_read_job_tables", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def s18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)


# --- telemetry ------------------------------------------------------------------------------------------------------------
@query("E01_latest_progress", f"WITH {STAGES} SELECT job_id, max(ts) AS ts, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status FROM stage_events GROUP BY job_id")
def e01(spark, d):
    return E.latest_progress(stage_events(spark, d))


def _streamed(spark, d, name):
    """A table as a stream: what its files hold when the query starts."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as the table may be one file


def _finished(spark, q, out):
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.option("recursiveFileLookup", True).parquet(out)


@query("E01_latest_progress_stream", SQL["E01_latest_progress"])
def e01_stream(spark, d):
    """The same from a stream with keyed state: what it has told of each job last."""
    key, out = "spark.sql.streaming.stateStore.providerClass", scratch(spark, "told")
    before = spark.conf.get(key)
    spark.conf.set(key, E.ROCKS)
    try:
        stages = as_stages(_streamed(spark, d, "events"))
        told = _finished(spark, E.stream_scoring(E.track_jobs(stages, idle="4000 days"), lambda df: df, out, scratch(spark, "told-state")), out)
    finally:
        spark.conf.set(key, before)
    return E.latest_told(told).withColumn("ts", F.col("ts").cast(table(spark, d, "events").schema["ts"].dataType))


@query("E07_stream_scoring", r"WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN 1 - len(list_distinct(ws))::DOUBLE / len(ws) ELSE 0 END::DOUBLE AS score FROM w")
def e07(spark, d):
    """Each arriving turn's share of repeated words, written batch by batch."""
    out = scratch(spark, "scored")

    def score(df):
        w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
        return df.select("conv_id", "turn", F.when(F.size(w) > 0, 1 - F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0).alias("score"))

    return _finished(spark, E.stream_scoring(_streamed(spark, d, "conversations"), score, out, scratch(spark, "scored-state")), out)


@query("E02_stage_duration", f"WITH {STAGES} SELECT job_id, stage, min(ts) AS started_at, max(ts) AS finished_at, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms FROM stage_events GROUP BY ALL")
def e02(spark, d):
    return E.stage_duration(stage_events(spark, d))


@query("E03_stage_latency_rollup", f"WITH {STAGES} SELECT date_trunc('hour', ts) AS hour, stage, count(*) AS n, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM stage_events GROUP BY ALL")
def e03(spark, d):
    return E.latency_rollup(stage_events(spark, d))


@query("E04_failed_stage_policy", f"WITH {STAGES} SELECT job_id, bool_or(status = 'failed' AND stage = 'error') AS failed, count(*) FILTER (status = 'failed') AS n_failed FROM stage_events GROUP BY job_id")
def e04(spark, d):
    return E.failed_jobs(stage_events(spark, d), ["error"])


@query("E05_retry_counts", f"WITH {STAGES} SELECT job_id, stage, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failures, arg_max(status, (ts, event_id)) AS final_status FROM stage_events GROUP BY ALL")
def e05(spark, d):
    return E.retry_counts(stage_events(spark, d))


@query("E06_retention", f"WITH {STAGES}, l AS (SELECT job_id, max(ts) AS last FROM stage_events GROUP BY job_id) SELECT count(*) FILTER (last < m - INTERVAL 7 DAY) AS deleted, count(*) FILTER (last >= m - INTERVAL 7 DAY) AS kept FROM l, (SELECT max(last) AS m FROM l)")
def e06(spark, d):
    return E.retention(stage_events(spark, d), 7)


@query("E08_job_state", f"WITH {STAGES} SELECT job_id, min(ts) FILTER (stage <> 'error') AS started_at, max(ts) FILTER (stage IN ('purchase', 'error')) AS completed_at, arg_max(status, (ts, event_id)) AS state FROM stage_events GROUP BY job_id")
def e08(spark, d):
    return E.job_state(stage_events(spark, d), F.col("stage") != "error", F.col("stage").isin("purchase", "error"))
