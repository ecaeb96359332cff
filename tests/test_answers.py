"""Answer operators against plain Python, and cases that the given tables do not have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritrail.catalog import QUERIES
from veritrail.functions import entities as N
from veritrail.functions import rules as R
from veritrail.functions import selection as E
from veritrail.operators import answers as A
from veritrail.operators import evidence as V
from veritrail.operators import features as X
from veritrail.operators import plugins as P
from veritrail.plans.views import predictions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def entities(spark, text):
    return [(e.text, e.label) for e in one(spark, e=N.extract_entities(F.lit(text))).e]


def test_entities(spark):
    assert entities(spark, "The France national team beat Ligue 1 side Real Madrid in May 2021.") == [
        ("Real Madrid", "SPORTS_TEAM"), ("2021", "DATE"), ("2021", "NUMBER"), ("The France national team", "SPORTS_TEAM"), ("Ligue 1", "COMPETITION"),
    ]
    assert ("Barcelona in Spain", "SPORTS_TEAM") in entities(spark, "Anna Berg plays for Barcelona in Spain")
    assert entities(spark, "Lamine Yamal Nasraoui is Spanish.") == [("Lamine Yamal Nasraoui", "PERSON"), ("Spanish", "NATIONALITY"), ("Lamine Yamal Nasraoui", "PERSON")]
    assert entities(spark, "The United States and Apple") == [("United States", "COUNTRY")]
    assert entities(spark, None) == [] and entities(spark, "") == []


def test_sentence_scores(spark):
    doc = "Berlin is the capital of Germany. It is known for its museums and art. Munich is not the capital of Germany."
    s = one(spark, s=E.score_sentences(F.lit(doc), F.lit("Berlin is the capital of Germany."), F.lit(None).cast("array<string>"))).s
    assert [x.pos for x in s] == [0, 1, 2] and s[0].ent == 1.0 and s[0].sim == 1.0 and s[0].score > s[1].score
    assert s[2].ent == 0.5 and s[2].contradiction == pytest.approx(0.85)  # denies, with half of the names
    best = one(spark, x=E.select_sentences(E.score_sentences(F.lit(doc), F.lit("Berlin is the capital of Germany."), F.lit(None).cast("array<string>")), F.lit(doc))).x
    assert best.excerpt == "Berlin is the capital of Germany." and best.strength == 0.95
    none = one(spark, x=E.select_sentences(E.score_sentences(F.lit("Short."), F.lit("x"), F.lit(None).cast("array<string>")), F.lit("Short."))).x
    assert none.sentences == ["Short."] and none.strength == 0.5
    assert one(spark, x=E.best_excerpt(F.lit(""), F.array(F.lit("a")))).x == ""


def test_rank_evidence(spark):
    rows = [
        ("c", "Lionel Messi is a footballer", "a", "Lionel Messi", "Lionel Messi is a footballer"), ("c", "Lionel Messi is a footballer", "b", "Lionel", "Lionel is a footballer name"),
        ("c", "Lionel Messi is a footballer", "d", "Messi (2014 film)", "Messi is a film"), ("c", "Lionel Messi is a footballer", "e", "2023-24 season of Lionel Messi", "Lionel Messi is a footballer too"),
        ("c", "Lionel Messi is a footballer", "f", "Lionel Messi", "Lionel Messi is a  footballer"), ("c", "Lionel Messi is a footballer", "g", "Messi (disambiguation)", "x"),
    ]
    df = spark.createDataFrame(rows, "claim_id string, claim string, page_id string, title string, text string").withColumn("url", F.lit(None).cast("string"))
    got = V.rank_evidence(df, 5).orderBy("rank").collect()
    assert [(r.page_id, r["rank"], r.score) for r in got] == [("a", 1, 1.0)]
    only = V.rank_evidence(df.where("page_id = 'g'"), 5, 0.0).collect()
    assert [r.page_id for r in only] == ["g"]  # nothing else is left


def test_team_profiles(spark):
    rows = [(1, 0, "He plays for Real Madrid. He left Paris Club in 2024. He captains the France team."), (2, 0, "She is a former captain. She signed for Harbor Town in 2018.")]
    got = {r.id: r for r in A.team_profiles(spark.createDataFrame(rows, "id int, pos int, text string")).collect()}
    assert got[1].current == ["france team", "real madrid"] and got[1].former == ["paris club"] and got[1].current_roles == ["captain"]
    assert got[2].former == ["harbor town"] and got[2].former_roles == ["captain"]
    v = one(spark, v=A.team_verdict(F.lit("She is the captain"), *[F.array().cast("array<string>")] * 3, F.array(F.lit("captain")))).v
    assert v.verdict == "contradicted"


def test_traces(spark, sf_dir):
    """Counts of claims are those of the view; a query without pages has one candidate that is not accepted."""
    got = QUERIES["V20_pipeline_trace"](spark, sf_dir).collect()
    assert got and all((r.n_claims, r.n_supported, r.n_contradicted, r.n_insufficient) == (4, 1, 1, 2) for r in got)
    assert all(r.accepted == (0 if r.entity.startswith("Zzyzx") else r.candidates) and r.candidates > 0 for r in got)
    assert {r.retried for r in got} == {True, False}


def _pooled(rows):
    """Isotonic regression by pooling neighbours that violate the order; rows: (p, y)."""
    by = {}
    for p, y in rows:
        by.setdefault(p, []).append(y)
    blocks = []
    for p in sorted(by):
        blocks.append([[p], sum(by[p]), len(by[p])])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            ps, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + ps, blocks[-1][1] + s, blocks[-1][2] + n]
    return {p: s / n for ps, s, n in blocks for p in ps}


def test_calibrators(spark, sf_dir):
    rows = {r.id: r for r in predictions(spark, sf_dir).select("id", "p", "y").collect()}
    want = _pooled([(r.p, r.y) for r in rows.values()])
    got = QUERIES["M11_calibrators"](spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r.isotonic == pytest.approx(want[rows[r.id].p], abs=1e-9) for r in got)
    order = sorted(got, key=lambda r: rows[r.id].p)
    steps = {(b.platt - a.platt) >= -1e-12 for a, b in zip(order, order[1:])} | {(b.platt - a.platt) <= 1e-12 for a, b in zip(order, order[1:])}
    assert steps and all(0 < r.platt < 1 and 0 < r.gated < 1 for r in got)
    mean = sum(r.y for r in rows.values()) / len(rows)
    assert sum(r.platt for r in got) / len(got) == pytest.approx(mean, abs=0.01)  # the intercept is not regularised


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.3)], "id int, p double")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    r = X.oof_faults(df, keys, "id", "p").first()
    assert (r.missing, r.repeated, r.not_finite, r.distinct_scores) == (1, 1, 0, 3)
    for bad in (lambda: X.require_sound_oof(df, keys, "id", "p"), lambda: X.require_threshold_source("test"), lambda: X.schema_row(df), lambda: P.with_entry({"a": len}, "a", len), lambda: P.retrieve_all(df, {}, 1)):
        with pytest.raises(ValueError):
            bad()
    X.require_sound_oof(df.where("p < 0.25"), keys.where("id < 3"), "id", "p")
    X.require_threshold_source("development_oof")


def test_lexical_verdict(spark):
    r = one(spark, a=R.lexical_verdict(F.lit(0.1), F.lit(0.5)), b=R.lexical_verdict(F.lit(0.1), F.lit(0.2)), c=R.lexical_verdict(F.lit(0.1), F.lit(0.0)), d=R.word_match(F.lit("Long words count, yes."), F.lit("some LONG words")))
    assert (r.a.verdict, r.a.confidence) == ("supported", 0.8) and r.b.verdict == "partial" and r.c.verdict == "contradicted" and r.d == 0.5


def test_decisions_are_made_consistent(spark):
    rows = [("a", 2, 1, 1, 0, 1, "yes"), ("b", 2, 0, 1, 0, 0, "yes"), ("c", 4, 1, 2, 1, 0, "yes"), ("d", 0, 0, 0, 0, 0, "uncertain")]
    df = spark.createDataFrame(rows, "response_id string, n_claims int, n_supported int, n_contradicted int, kept_contradictions int, kept_support int, decision string")
    got = {r.response_id: (r.decision, r.probability, r.confidence) for r in A.decision_scores(df).collect()}
    assert got == {"a": ("no", 0.0, 0.5), "b": ("uncertain", 0.5, 0.0), "c": ("yes", 0.5, 0.5), "d": ("uncertain", 0.5, 0.0)}
