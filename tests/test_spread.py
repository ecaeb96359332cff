"""Queries whose rows take much work deal them to tasks, and do that work once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritrail.plans import profiles, q_entities


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("spread"))
    spark.range(1, 20_001, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    return d


def test_rows_of_a_small_file_are_many_tasks(spark, customers):
    for rows in (profiles.people(spark, customers), profiles.cases(spark, customers)):
        assert rows.rdd.getNumPartitions() == 5
        assert rows.count() == 20_000


def test_names_are_recognized_once(spark, customers):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = plan(q_entities.recognized(spark, customers).select("claim_id", "es")).count("regexp_extract_all")
    assert once > 0
    assert plan(q_entities.w11(spark, customers)).count("regexp_extract_all") == once


def test_rules_are_asked_once(spark, customers):
    from veritrail.functions import rules as R

    df = profiles.cases(spark, customers).limit(3000).select("text", "texts", R.run_checkers(F.col("text"), F.col("texts")).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("prime number|visible") == 1
    assert {r.checker for r in df.select("v.checker").distinct().collect()} == {None, "entity", "negation", "location", "fact_attribute", "numeric"}


def test_pages_are_cut_before_they_meet_claims(spark, customers):
    from veritrail.plans import q_selection

    plan = q_selection.w06(spark, customers)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "citation needed" in below and "regexp" not in above and "split" not in above


def test_scores_in_rows_are_those_in_arrays(spark, customers):
    from veritrail.functions import selection as E

    df = profiles.pages(profiles.people(spark, customers)).limit(60).select("page_id", F.col("text").alias("doc"), F.lit("Anna Abbott is not the CEO of Acme Inc.").alias("claim"))
    df = df.unionByName(spark.createDataFrame([("x", "Of the and it is not. Paris became a city of France.", "of the")], "page_id string, doc string, claim string"))
    arrays = df.select("page_id", F.inline(E.score_sentences(F.col("doc"), F.col("claim"), F.array(F.lit("Anna Abbott")))))
    rows = E.score_rows(df.select("page_id", E.sentence_parts(F.col("doc")).alias("parts"), E.claim_parts(F.col("claim"), F.array(F.lit("Anna Abbott"))).alias("about")), "page_id")
    assert sorted(arrays.collect()) == sorted(rows.collect()) and rows.count() > 60


def test_words_of_pages_are_taken_before_they_meet_claims(spark, customers):
    from veritrail.plans import q_selection

    plan = q_selection.w08(spark, customers)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join", 1)[0]
    assert "array_distinct" not in above and "array_distinct" in plan


def test_claims_are_ranked_in_tasks_of_a_fixed_size(spark, customers):
    from veritrail.plans import q_selection

    plan = q_selection.w08(spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(claim_id" in plan and ", 5), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("together", [64, 5, 0])
def test_near_duplicates_of_small_and_large_claims(spark, together):
    """Arrays of small claims and rounds of large ones stay with the same items, which plain Python tells."""
    from veritrail.operators import retrieval

    words = ["alpha beta gamma delta epsilon zeta eta", "Alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta eta theta", "one two", "three", "two one", "four five", None]
    rows = [(c, p, words[(c * 3 + p * 5) % 8], round(((p * 7 + c) % 5) / 5, 1)) for c in range(12) for p in range(c)] + [(None, p, words[p], 0.5) for p in range(6)]
    df = spark.createDataFrame(rows, "claim_id int, pos int, text string, score double")
    want = set()
    for c in [None, *range(12)]:
        kept = []
        for _, p, t in sorted(((-s, p, t) for k, p, t, s in rows if k == c), key=lambda x: x[:2]):
            w = None if t is None else set(t.lower().split())
            if not kept or (c is not None and len(kept) < 3 and w is not None and all(k is not None and len(w & k) / len(w | k) < 0.85 for _, k in kept)):
                kept.append((p, w))
        want |= {(c, i + 1, p) for i, (p, _) in enumerate(kept)}
    assert {tuple(r) for r in retrieval.dedup_near(df, together=together).collect()} == want


def test_claims_of_templates_are_dealt_by_claim(spark, sf_dir, monkeypatch):
    from veritrail.plans import q_reports, q_text, views

    monkeypatch.setattr(views, "TEMPLATED_ROWS", 300)
    assert views.templated_rows(spark, sf_dir).rdd.getNumPartitions() > 4
    plan = q_text.with_evidence(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0
    monkeypatch.setattr(q_reports, "TEMPLATED_ROWS", 300)
    plan = q_reports.a09(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 1


def test_facts_are_dealt_to_tasks(spark):
    from veritrail.operators import retrieval

    facts = spark.range(0, 12_000, 1, 1).select(F.col("id").alias("fact_id"), F.concat(F.lit("common word "), F.col("id") % 7).alias("text"))
    claims = spark.createDataFrame([("a", "common 3"), ("b", "word 5")], "claim_id string, text string")
    found = retrieval.lexical_retrieve(claims, facts)
    assert "fact" in found._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]
    assert [(r.claim_id, r.fact_id, r.score) for r in found.orderBy("claim_id", "rank").collect()] == [("a", 3, 2), ("a", 10, 2), ("a", 17, 2), ("b", 5, 2), ("b", 12, 2), ("b", 19, 2)]
