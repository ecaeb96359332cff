"""Queries of what users can put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import answers as A
from ..operators import plugins as P
from .profiles import PROFILES, answers, claims, pages, people
from .q_answers import _P
from .q_text import _TYPE, sql_factual, strip
from .registry import query, table
from .views import PRED, predictions


@query("X01_checker", f"WITH {PROFILES} SELECT claim_id, CASE WHEN pos = 0 THEN 'supported' END AS verdict, CASE WHEN pos = 0 THEN 'office' END AS checker FROM pcl")
def x01(spark, d):
    office = lambda claim, evidence: F.when(T.matches(claim, r"\bCEO\b"), R.verdict("supported", 0.8))
    checkers = P.with_entry({"location": R.location}, "office", office)
    v = R.run_checkers(F.col("text"), F.array(F.lit("Nothing is known.")), checkers)
    return claims(people(spark, d)).select("claim_id", v.alias("v")).select("claim_id", "v.verdict", "v.checker")


@query("X02_evidence_provider", f"WITH {PROFILES} SELECT 'first' AS provider, c.claim_id, p.source, p.score FROM pcl c JOIN ppg p USING (k) WHERE p.n < 2 UNION ALL SELECT 'about', c.claim_id, p.source, 1.0 FROM pcl c JOIN ppg p USING (k) WHERE p.title = c.person")
def x02(spark, d):
    ppl = people(spark, d)
    p = pages(ppl).select("k", "n", "title", "text", "source", "score")
    providers = P.with_entry({"first": lambda c, k: c.join(p, "k").where(F.col("n") < k)}, "about", lambda c, k: c.join(p.drop("score"), "k").where("title = person").withColumn("score", F.lit(1.0)))
    return P.retrieve_all(claims(ppl).drop("text"), providers, 2).select("provider", "claim_id", "source", "score")


@query("X03_claim_extractor", rf"WITH {PROFILES}, {_P} SELECT 'split' AS extractor, response_id AS id, pos::INT AS pos, claim FROM split UNION ALL SELECT 'whole', response_id, 0, response FROM pan")
def x03(spark, d):
    texts = answers(people(spark, d)).select(F.col("response_id").alias("id"), F.col("response").alias("text"))
    whole = lambda t: t.select("id", F.lit(0).alias("pos"), F.col("text").alias("claim"))
    split = lambda t: A.split_claims(t.select(F.col("id").alias("response_id"), F.col("text").alias("response"))).withColumnRenamed("response_id", "id")
    return P.extract_with(texts, P.with_entry({"split": split}, "whole", whole))


@query("X04_claim_type", f"WITH {PROFILES} SELECT response_id, {_TYPE.replace(strip('s'), strip('response'))} AS kind, CASE WHEN {sql_factual('response')} THEN 'factual' ELSE 'other' END AS factual FROM pan")
def x04(spark, d):
    factual = lambda c: F.when(T.is_factual(c), "factual").otherwise("other")
    return P.classify_with(answers(people(spark, d)), "response", P.with_entry({"kind": T.claim_type}, "factual", factual)).select("response_id", "kind", "factual")


@query("X05_baseline", f"WITH {PRED} SELECT id, p2 AS length, (SELECT avg(y) FROM pred) AS prior FROM pred")
def x05(spark, d):
    prior = lambda df: F.lit(df.agg(F.avg("y")).first()[0])
    return P.score_with(predictions(spark, d), P.with_entry({"length": lambda df: F.col("p2")}, "prior", prior)).select("id", "length", "prior")


@query("X06_stage", "WITH d AS (SELECT doc_id, trim(text) AS t FROM documents), c AS (SELECT doc_id, len(string_split(t, chr(10))) AS n FROM d WHERE t <> '') SELECT n % 5 AS class, count(*) AS documents FROM c GROUP BY ALL")
def x06(spark, d):
    stages = {"strip": lambda df: df.select("doc_id", F.trim("text").alias("t")), "keep": lambda df: df.where("t <> ''"), "count": lambda df: df.select("doc_id", F.size(F.split("t", "\n")).alias("n"))}
    stages = P.with_entry(stages, "sum", lambda df: df.groupBy((F.col("n") % 5).alias("class")).agg(F.count("*").alias("documents")))
    return P.run_stages(table(spark, d, "documents"), stages)

