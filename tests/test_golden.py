"""Golden cases of claims, rules and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veritrail.functions import rules as R
from veritrail.functions import text as T
from veritrail.operators import metrics as M
from veritrail.operators import sampling as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def test_decompose(spark):
    s = "They are a South Korean boy group formed by JYP Entertainment in 2013."
    assert one(spark, s, T.extract_claims) == ["They are a South Korean boy group.", "They were formed by JYP Entertainment.", "They were formed in 2013."]


def test_text_nulls_and_blanks(spark):
    for v in (None, "", "   "):
        assert one(spark, v, T.extract_claims) in ([], None)
        assert one(spark, v, lambda c: T.sentences(c)) == []
    assert one(spark, "  ", T.claim_type) == "conversational_meta"


def test_clean_sentences(spark):
    s = "Apple was founded in 1976.[1] Its CEO is Tim Cook today.[citation needed] It is located in Cupertino.[2]"
    assert len(one(spark, s, T.clean_evidence_sentences)) == 3


def test_relations(spark):
    r = one(spark, "The capital of Germany is Munich.", T.relation)
    assert (r.relation, r.subject, r.object) == ("capital_of", "Germany", "Munich")
    r = one(spark, "The CEO of Apple is Tim Cook.", T.relation)
    assert (r.relation, r.subject, r.object) == ("ceo_of", "Apple", "Tim Cook")


def check(spark, claim, evidence, f):
    d = spark.createDataFrame([(claim, evidence)], "c string, e array<string>")
    r = d.select(f(F.col("c"), F.col("e")).alias("v")).first().v
    return r and (r.verdict, r.confidence)


def test_negative_support(spark):
    assert check(spark, "No, BTS is not from India.", ["BTS is a South Korean boy band formed in 2010."], R.verify) == ("supported", 0.90)


def test_rules(spark):
    assert check(spark, "The group was formed in 2012.", ["It was formed in 2010."], R.temporal) == ("contradicted", 0.94)
    assert check(spark, "It weighs 500 kg.", ["It weighs 510 kg."], R.numeric) == ("supported", 0.94)
    assert check(spark, "It weighs 500 kg.", ["It weighs 900 kg."], R.numeric) == ("contradicted", 0.94)
    assert check(spark, "Berlin hosts it.", ["It lies in Paris."], R.location) == ("contradicted", 0.96)
    assert check(spark, "Ukraine hosts it.", ["It lies in Paris."], R.location) is None  # "uk" inside a word does not count
    assert check(spark, "Anything at all.", [], R.verify) == ("insufficient", 0.30)


def test_plugin(spark):
    rule = lambda c, e: F.when(c.contains("moon"), R.verdict("contradicted", 0.5))
    assert check(spark, "The moon is cheese", ["x"], lambda c, e: R.run_checkers(c, e, {**R.CHECKERS, "moon": rule})) == ("contradicted", 0.5)


def test_metrics_example(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0), (1, 1)], "y int, h int")
    r = M.classification_metrics(d, "y", "h").first()
    assert (r.accuracy, r.precision, r.recall) == (0.8, 0.75, 1.0) and r.f1 > 0.8
    empty = M.classification_metrics(d.where("y > 5"), "y", "h", ["y"])
    assert empty.count() == 0


def test_calibration_example(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, p double")
    assert d.agg(M.brier("y", "p")).first()[0] < 0.1
    assert M.calibration_bins(d, "y", "p").count() == 10
    assert M.roc_auc(d, "y", "p").first().auroc == 1.0
    assert M.roc_auc(d.where("y = 1"), "y", "p").first().auroc == 0.5


def test_mcnemar_tail(spark):
    d = spark.createDataFrame([(1, 1, 0)] * 12 + [(1, 0, 1)] * 4, "y int, a int, b int")
    r = M.mcnemar(d, "y", "a", "b").first()
    assert (r.b, r.c) == (12, 4) and math.isclose(r.p_value, math.erfc(math.sqrt(r.statistic / 2)), rel_tol=1e-6)


def test_guards(spark):
    import pytest

    a = spark.createDataFrame([("Q ", "r")], "query string, response string")
    b = spark.createDataFrame([("q", "R")], "query string, response string")
    with pytest.raises(ValueError):
        S.require_clean(a, b)
    S.require_clean(a, b.where("query = 'z'"))


def test_split_is_whole(spark):
    d = spark.range(100).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    s = S.train_val_test(d, "id", "y")
    assert s.count() == 100 and s.where("split = 'train'").count() == 23 + 46
