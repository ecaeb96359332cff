"""Stacking, calibration, attribution and class summaries against plain Python."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veritrail.operators import features as X
from veritrail.operators import ml
from veritrail.operators import reports as P

N = 240


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    y = (rng.random(N) < 0.45).astype(int)
    x = rng.normal(size=(N, 3)) * [1, 5, 0.2] + y[:, None] * [0.9, 2.0, 0.0]
    return y, x


@pytest.fixture(scope="module")
def stack(spark, rows):
    y, x = rows
    df = spark.createDataFrame([(i, int(a), v.tolist()) for i, (a, v) in enumerate(zip(y, x))], "id long, y int, v array<double>").select("id", "y", array_to_vector("v").alias("v"))
    s = ml.Stack("id", ("lr", "svm"), seed=7).fit(df, "y", "v", 3)
    return s, s.oof.toPandas().sort_values("id"), s.predict(df, "v").toPandas().sort_values("id")


def _logistic(x, y, penalty=0.0):
    """Newton's method on the mean loss; the intercept is not penalised."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(x) + ridge + 1e-12 * np.eye(len(w)), a.T @ (p - y) / len(x) + ridge @ w)
    return w


def _apply(w, x):
    return 1 / (1 + np.exp(-(w[0] + x @ w[1:])))


def _isotonic(x, y):
    """Pool adjacent violators over distinct x, then straight lines between blocks' ends."""
    values = sorted(set(x))
    blocks = [[sum(t for s, t in zip(x, y) if s == v), sum(s == v for s in x), v, v] for v in values]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2], last[3]]
    ends = [(e, b[0] / b[1]) for b in out for e in dict.fromkeys((b[2], b[3]))]
    return np.interp(x, [e for e, _ in ends], [v for _, v in ends])


def test_folds_hold_every_row_once_and_are_stratified(stack, rows):
    _, oof, _ = stack
    y, _ = rows
    assert oof.id.tolist() == list(range(N)) and oof.label.astype(int).tolist() == y.tolist()
    for label in (0, 1):
        sizes = oof[oof.label == label].groupby("fold").size()
        assert sizes.max() - sizes.min() <= 1


def test_member_is_fitted_on_the_other_folds_alone(stack, rows):
    """Scaler and logistic regression of each fold, made again from the rows outside it."""
    _, oof, _ = stack
    y, x = rows
    fold = oof.fold.to_numpy()
    for f in range(3):
        train = fold != f
        mean, std = x[train].mean(0), x[train].std(0, ddof=1)
        w = _logistic((x[train] - mean) / std, y[train], 0.01)
        np.testing.assert_allclose(oof.lr[fold == f], _apply(w, (x[fold == f] - mean) / std), atol=2e-3)


def test_refit_on_all_rows(stack, rows):
    _, _, predicted = stack
    y, x = rows
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    np.testing.assert_allclose(predicted.lr, _apply(_logistic(z, y, 0.01), z), atol=2e-3)


def test_margins_become_probabilities(stack, rows):
    s, oof, _ = stack
    y, x = rows
    m = s.members["svm"]
    assert m.slope > 0 and 0.7 < np.mean((oof.svm >= 0.5) == y)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    margin = z @ m.model.coefficients.toArray() + m.model.intercept
    np.testing.assert_allclose(stack[2].svm, 1 / (1 + np.exp(-(margin * m.slope + m.offset))), atol=1e-9)


def test_meta_isotonic_and_threshold(stack, rows):
    s, oof, predicted = stack
    y, _ = rows
    inputs = oof[["lr", "svm"]].to_numpy()
    w = _logistic(inputs, y)
    np.testing.assert_allclose(oof.stacked, _apply(w, inputs), atol=2e-3)
    np.testing.assert_allclose(oof.calibrated, _isotonic(oof.stacked.tolist(), y.tolist()), atol=1e-6)
    youden = {t: np.mean(oof.calibrated[y == 1] >= t) + np.mean(oof.calibrated[y == 0] < t) - 1 for t in ml.THRESHOLDS}
    assert s.threshold == min(t for t in youden if youden[t] > max(youden.values()) - 1e-12)
    assert (oof.predicted == (oof.calibrated >= s.threshold)).all() and (predicted.predicted == (predicted.calibrated >= s.threshold)).all()


def test_importance_shares(spark):
    got = {r.group: (round(r.share, 6), r.top) for r in ml.importance_shares(spark, [0.1, 0.4, 0.0, 0.5], {"a": range(2), "b": range(2, 9)}, 2).collect()}
    assert got == {"a": (0.5, "1"), "b": (0.5, "3")}


@pytest.mark.parametrize("sharp", [0.02, 0.7, 1.0, 4.0])
def test_temperature_against_a_fine_grid(spark, sharp):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-z))).astype(int)
    p = np.clip(1 / (1 + np.exp(-z * sharp)), 1e-6, 1 - 1e-6)
    logit = np.log(p / (1 - p))

    def loss(t):
        s = np.clip(1 / (1 + np.exp(-logit / t)), 1e-7, 1 - 1e-7)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grid = np.exp(np.linspace(math.log(0.01), math.log(10), 40_000))
    best = min(map(loss, grid))
    r = ml.temperature_scaling(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), "y", "p").first()
    assert r.nll <= best + 1e-9 and r.nll == pytest.approx(loss(r.temperature), abs=1e-9) and 0.01 <= r.temperature <= 10.0000001


def test_temperature_of_nothing(spark):
    assert ml.temperature_scaling(spark.createDataFrame([], "y int, p double"), "y", "p").count() == 0


def test_deletions_are_scored_anew(spark):
    texts = [("a", "one two three three of of it", "of it"), ("b", "x", "x"), ("c", "", "q"), ("d", "aa bb", "zz")]
    df = spark.createDataFrame([(i, t.split(), k.split()) for i, t, k in texts], "id string, w array<string>, k array<string>")
    got = {(r.id, r.k): r for r in X.deletion_scores(df.select("id", X.ungrounded(F.col("w"), F.col("k")).alias("parts")), [1, 2, 9]).collect()}

    def score(words, known):
        return sum(len(w) for w in words if w not in known) / sum(map(len, words)) if words else 0.0

    assert len(got) == 12
    for i, t, known in texts:
        words, known = t.split(), known.split()
        without = lambda j: score(words[:j] + words[j + 1 :], known)
        top = sorted(range(len(words)), key=lambda j: (without(j), j))
        drawn = sorted(range(len(words)), key=lambda j: hashlib.md5(f"{i}:{j + 1}:42".encode()).hexdigest())
        for k in (1, 2, 9):
            left = lambda order: score([w for j, w in enumerate(words) if j not in order[:k]], known)
            r = got[i, k]
            assert (r.original, r.top_deleted, r.random_deleted) == pytest.approx((score(words, known), left(top), left(drawn)))


def test_class_distances_over_all_pairs(spark):
    rng = np.random.default_rng(6)
    label, x = rng.integers(0, 3, 60), rng.normal(size=(60, 4))
    x[0] = 0
    df = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(label, x)], "label int, v array<double>")
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    for r in P.class_distances(df).collect():
        a, b = label == r.label_a, label == r.label_b
        assert r.centroid_distance == pytest.approx(np.linalg.norm(x[a].mean(0) - x[b].mean(0)))
        assert r.cosine == pytest.approx((unit[a] @ unit[b].T).mean())
    t = P.feature_totals(df.withColumn("v", F.concat("v", F.array(F.lit(2.0))))).first()
    assert t.near_zero_dims == 1 and t.variance == pytest.approx(x.var(0).sum() / 5)
    assert t.mean_l2 == pytest.approx(np.linalg.norm(np.column_stack((x, np.full(60, 2.0))), axis=1).mean())


def test_levels_and_propagation(spark):
    df = spark.createDataFrame([(0.95, 0.8, 0.6, 0.1), (1.0, 1.0, 1.0, 0.0)], "a double, b double, c double, d double")
    one, zero = df.select(*(v.alias(k) for k, v in P.propagated({c: F.col(c) for c in "abcd"}).items())).collect()
    assert (one.a_level, one.b_level, one.c_level, one.d_level) == ("Very Low", "Low", "Moderate", "Very High")
    assert one.overall == round((0.95 * 0.8 * 0.6 * 0.1) ** 0.25, 4) and one.level == "High"
    assert zero.overall == 0.1


def test_few_tasks_of_inner_folds_hold_no_sorts(spark, rows):
    y, x = rows
    df = spark.createDataFrame([(i, float(a), v.tolist()) for i, (a, v) in enumerate(zip(y, x))], "id long, label double, v array<double>").select("id", "label", array_to_vector("v").alias("features")).coalesce(1)
    parts = ml.MarginClassifier("id").inner_folds(df)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan and not any(x in plan for x in ("Sort", "Window", "Exchange"))
    assert parts.count() == N and {r.fold for r in parts.select("fold").distinct().collect()} == {0, 1, 2}
