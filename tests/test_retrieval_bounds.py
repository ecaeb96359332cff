"""Bounded retrieval against all pairs, on tables with words and vectors that nearly every row has."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import metrics as M
from veritrail.operators import retrieval, vectors


def _top(asked, facts, k):
    out = []
    for i, words in asked:
        scored = sorted((-len(set(words) & set(ws)), f) for f, ws in facts if set(words) & set(ws))[:k]
        out += [(i, f, -s, r) for r, (s, f) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("often", [1, 4, 30, 10**6])
def test_shared_words_match_all_pairs(spark, often):
    rng = random.Random(often)
    frequent, seldom = ["the", "of", "group", "inc"], [f"w{i}" for i in range(60)]

    def words():
        return [w for w in frequent if rng.random() < 0.6] + rng.sample(seldom, rng.randrange(4))

    asked = [(i, words()) for i in range(120)] + [(500, []), (501, ["unknown"]), (502, ["the", "the"])]
    facts = [(f"f{i:03}", words()) for i in range(90)] + [("empty", [])]
    found = retrieval.shared_words(spark.createDataFrame(asked, "id long, words array<string>"), spark.createDataFrame(facts, "fact string, words array<string>"), 3, often)
    assert sorted(map(tuple, found.select("id", "fact", "score", "rank").collect())) == _top(asked, facts, 3)


def test_join_does_not_grow_with_frequent_words(spark):
    """Twice the rows that all share two words: the rows that joins make about double."""

    def made(n):
        asked = spark.range(n).select("id", F.array(F.lit("group"), F.lit("inc"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("words"))
        facts = spark.range(n).select(F.col("id").alias("fact"), F.array(F.lit("inc"), F.when(F.col("id") % 2 == 0, "group").otherwise("other"), F.concat(F.lit("x"), (F.col("id") * 3).cast("string"))).alias("words"))
        found = retrieval.shared_words(asked, facts, 3, 50)
        rows = found.collect()
        todo, most = [found._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if "QueryStage" in node.nodeName():
                todo.append(node.plan())
                continue
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return rows, most

    few, a = made(400)
    many, b = made(800)
    assert len(few) == 1200 and len(many) == 2400
    assert 0 < a <= b <= 3 * a and b < 800 * 800 / 20


def test_nearest_matches_all_pairs(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 3), ("HELD_BLOCKS", 1)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 5)), 1)
    x[40:90] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    got = vectors.nearest(df.where("id % 7 = 0"), df, 4)
    true = []
    for q in range(0, 150, 7):
        scored = sorted((-float(sum(a * b for a, b in zip(x[q], x[i]))), i) for i in range(150) if i != q)[:4]
        true += [(q, i, r) for r, (_, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.select("query_id", "vec_id", "rank").collect())) == sorted(true)
    assert vectors.nearest(df.limit(0), df, 4).count() == 0 and vectors.nearest(df, df.limit(0), 4).count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_class_metrics_equal_listed_gold(spark):
    rng = random.Random(3)
    labels = [(i, rng.choice([0, 0, 0, 1, 2])) for i in range(60)] + [(99, 7)]
    corpus = spark.createDataFrame(labels, "doc_id long, label int")
    queries = corpus.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), "label")
    ranked = spark.createDataFrame([(q, d, r) for q in range(0, 100, 9) for r, d in enumerate(rng.sample([i for i in range(60) if i != q], 8), 1)], "query_id long, doc_id long, rank int")
    gold = queries.join(corpus, "label").where("query_id <> doc_id").select("query_id", "doc_id")
    one, other = M.class_retrieval_metrics(ranked, queries, corpus, 5).first(), M.retrieval_metrics(ranked, gold, 5).first()
    assert one.n_queries == other.n_queries and np.allclose(one[1:], other[1:])


def test_alias_join_by_shuffle(spark, monkeypatch):
    names = spark.createDataFrame([(1, "Acme"), (2, "acme "), (3, "Other")], "id int, name string")
    aliases = spark.createDataFrame([("ACME", "Acme Inc."), ("acme", "Acme Corp.")], "alias string, title string")
    rows = lambda: sorted(map(tuple, retrieval.alias_join(names, aliases).select("id", "title").collect()))
    before = rows()
    monkeypatch.setattr(retrieval, "BROADCAST_ALIASES", 0)
    assert rows() == before == [(1, "Acme Corp."), (2, "Acme Corp."), (3, "Other")]


def _prose(seed):
    rng = random.Random(seed)
    words = lambda: [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(12))]
    return [(f"c{i}", words()) for i in range(70)] + [("none", []), ("null", None)], [(i, words()) for i in range(50)] + [(900, []), (901, None)]


@pytest.mark.parametrize("sizes", [(10**6, 10**6), (60, 40), (1, 1)])
def test_blocked_shared_words_match_all_pairs(spark, sizes):
    asked, facts = _prose(3)
    found = retrieval.shared_words_blocked(spark.createDataFrame(asked, "id string, words array<string>"), spark.createDataFrame(facts, "fact long, words array<string>"), 3, *sizes)
    assert sorted(map(tuple, found.select("id", "fact", "score", "rank").collect())) == _top([(i, w or []) for i, w in asked], [(f, w or []) for f, w in facts], 3)


def test_prose_makes_no_rows_for_shared_words(spark):
    """The flagship's retrieval: rows of its plan stay near ids x cells, though all ids share words with all facts."""
    asked, facts = [(f"c{i}", [f"w{j}" for j in range(20)]) for i in range(300)], [(i, [f"w{j}" for j in range(20)]) for i in range(300)]
    found = retrieval.shared_words_blocked(spark.createDataFrame(asked, "id string, words array<string>"), spark.createDataFrame(facts, "fact long, words array<string>"), 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.select("fact", "score", "rank").collect()} == {(0, 20, 1), (1, 20, 2), (2, 20, 3)}


def test_document_support_matches_rules(spark):
    from veritrail.functions import rules as R
    from veritrail.functions import text as T

    texts = [(1, "The harbor of Nordwind was built in 1950. It lies in France near the river.  Short. Many ships visit the harbor of Nordwind."), (2, None), (3, "Short.")]
    claims = [("a", "Nordwind harbor was built in France."), ("b", "No such thing \"....\" here."), ("c", "It is."), ("d", "")]
    c, d = spark.createDataFrame(claims, "claim_id string, text string"), spark.createDataFrame(texts, "fact_id long, text string")
    found = c.select("claim_id").crossJoin(d.select("fact_id")).where("claim_id <> 'd' OR fact_id = 1")
    got = {r.claim_id: (r.best, r.match) for r in retrieval.document_support(found, c, d).collect()}
    j = found.join(c, "claim_id").join(d.select("fact_id", F.col("text").alias("doc")), "fact_id")
    match = {r.claim_id: r.m for r in j.groupBy("claim_id").agg(F.max(R.word_match(F.col("text"), F.col("doc"))).alias("m")).collect()}
    s = j.select("claim_id", "text", F.explode_outer(T.sentences(F.col("doc"), "mark", 15)).alias("s"))
    best = {r.claim_id: r.b for r in s.groupBy("claim_id").agg(F.max(F.coalesce(T.word_overlap(F.col("text"), F.col("s")), F.lit(0.0))).alias("b")).collect()}
    assert got == {k: (best[k], match[k]) for k in got} and set(got) == set("abcd")
