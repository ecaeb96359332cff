"""Ranks, percentiles and bootstrap intervals against plain Python, with one group that holds most rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import metrics as M
from veritrail.operators import ranks, resampling, sampling


def _draw(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "hot" if i % 10 < 8 else [None, "a", "b"][i % 3]) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id long, label string").repartition(7).persist()


def _ranked(rows, seed=42):
    by = {}
    for i, y in rows:
        by.setdefault(y, []).append(i)
    return {i: (at, len(ids)) for ids in by.values() for at, i in enumerate(sorted(ids, key=lambda i: (_draw(i, seed), i)), 1)}


def test_ranks_of_a_hot_label(labelled):
    rows, df = labelled
    got = {r.id: (r["__rank"], r["__n"]) for r in ranks.draw_ranked(df, ["label"], "id", 42).collect()}
    assert got == _ranked(rows)
    few = ranks.draw_ranked(df, ["label"], "id", 42, F.lit(7))
    assert {r.id for r in few.collect()} == {i for i, (at, _) in _ranked(rows).items() if at <= 7}


def test_no_window_over_a_whole_label(labelled):
    plan = sampling.stratified_kfold(labelled[1], "id", "label")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("__range" in line for line in windows)


def test_splits_and_folds(labelled):
    rows, df = labelled
    true = _ranked(rows)
    folds = {r.id: r.fold for r in sampling.stratified_kfold(df, "id", "label", 5).collect()}
    assert folds == {i: (at - 1) % 5 for i, (at, _) in true.items()}
    split = {r.id: r.split for r in sampling.train_val_test(df, "id", "label").collect()}
    assert split == {i: "train" if at <= int(n * 0.7) else "validation" if at <= int(n * 0.7) + int(n * 0.15) else "test" for i, (at, n) in true.items()}
    taken = {r.id for r in sampling.quota_sample(df, "id", "label", {"hot": 30, "a": 5}).collect()}
    label = dict(rows)
    assert taken == {i for i, (at, _) in true.items() if at <= {"hot": 30, "a": 5}.get(label[i], 0)}


@pytest.mark.parametrize("bounds", [3, 255])
def test_percentiles_are_exact(spark, bounds):
    rng = random.Random(1)
    rows = [("hot", rng.choice([0.5, 0.5, rng.expovariate(1), -rng.random() * 1e9])) for _ in range(3000)] + [("one", 4.0), ("ties", 1.0), ("ties", 1.0), ("ties", 9.0), (None, 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: [r[s] for s in shares] for r in ranks.percentiles(df, "v", shares, ["g"], bounds).collect()}
    true = {g: np.percentile([v for h, v in rows if h == g], [100 * s for s in shares.values()]) for g in {g for g, v in rows if v is not None}}
    assert got.keys() == true.keys()
    for g in true:
        np.testing.assert_allclose(got[g], true[g], rtol=1e-12)
    whole = M.latency_profile(df, "v").first()
    assert whole.median == pytest.approx(np.percentile([v for _, v in rows if v is not None], 50))
    empty = M.latency_profile(df.where("g = 'nobody'"), "v").first()
    assert empty.n == 0 and empty.median is None
    assert {r.g: r.median for r in M.latency_profile(df, "v", ["g"]).collect()}["none"] is None


def _predictions(n=700):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.4).astype(int)
    p = np.round(np.clip(0.35 * y + rng.normal(0.35, 0.2, n), -0.1, 1.2), 2)
    q = np.round(np.clip(0.1 * y + rng.normal(0.45, 0.2, n), 0, 1), 2)
    return [(i, int(a), float(b), float(c), "ab"[i % 2]) for i, (a, b, c) in enumerate(zip(y, p, q))]


def _auc(y, p, w):
    pos, neg = [(s, v) for t, s, v in zip(y, p, w) if t == 1], [(s, v) for t, s, v in zip(y, p, w) if t == 0]
    wins = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
    return wins / (sum(a for _, a in pos) * sum(b for _, b in neg))


def _precision(y, p, w):
    order = sorted(set(p), reverse=True)
    tp = n = 0
    out = 0.0
    for s in order:
        a = sum(v for t, x, v in zip(y, p, w) if x == s and t == 1)
        tp, n = tp + a, n + sum(v for x, v in zip(p, w) if x == s)
        out += a * (tp / n if n else 0)
    return out / tp


def test_bootstrap_matches_replicates_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CELLS_AT_ONCE", 7)  # ties reach over pieces
    rows = _predictions()
    df = spark.createDataFrame(rows, "id long, y int, p double, q double, g string").repartition(3)
    cells = resampling.cells(df, "y", ["p"]).collect()
    assert sum(c.n for c in cells) == len(rows)
    w = resampling.draws(np.array([c.key for c in cells]), np.array([c.n for c in cells]), 5, 42)
    found = resampling.bootstrap_metrics(df, "y", "p", 0.5, replicates=5)[""]
    y, p = [c.label for c in cells], [c.p for c in cells]
    for r in range(5):
        weight = w[:, r].tolist()
        tp, fp, fn, tn = (sum(v for t, s, v in zip(y, p, weight) if (t, s >= 0.5) == cell) for cell in ((1, True), (0, True), (1, False), (0, False)))
        assert found["accuracy"][r] == pytest.approx((tp + tn) / (tp + fp + fn + tn))
        assert found["precision"][r] == pytest.approx(tp / (tp + fp))
        assert found["f1"][r] == pytest.approx(2 * tp / (2 * tp + fp + fn))
        assert found["auroc"][r] == pytest.approx(_auc(y, p, weight))
        assert found["average_precision"][r] == pytest.approx(_precision(y, p, weight))


def test_intervals_agree_with_resampled_rows(spark):
    rows = _predictions()
    df = spark.createDataFrame(rows, "id long, y int, p double, q double, g string")
    got = {r.metric: r for r in resampling.bootstrap_ci(df, "y", "p").collect()}
    assert set(got) == set(resampling.METRICS)
    rng = np.random.default_rng(0)
    y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    accuracy = [((p >= 0.5) == y)[rng.integers(0, len(y), len(y))].mean() for _ in range(2000)]
    low, high = np.percentile(accuracy, [2.5, 97.5])
    assert abs(got["accuracy"].low - low) < 0.01 and abs(got["accuracy"].high - high) < 0.01
    assert got["auroc"].low < _auc(y, p, np.ones(len(y))) < got["auroc"].high
    again = resampling.bootstrap_ci(df.repartition(9), "y", "p")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))  # partitions don't matter
    by = resampling.bootstrap_ci(df, "y", "p", by="g", replicates=50).groupBy("g").count().collect()
    assert sorted(map(tuple, by)) == [("a", 6), ("b", 6)]


def test_paired_bootstrap(spark):
    df = spark.createDataFrame(_predictions(), "id long, y int, p double, q double, g string")
    r = resampling.paired_bootstrap(df, "y", "p", "q").first()
    assert 0 < r.low < r.delta < r.high and r.p_value == 0.001
    same = resampling.paired_bootstrap(df, "y", "p", "p", replicates=20).first()
    assert (same.delta, same.low, same.high, same.p_value) == (0, 0, 0, 1)
    assert resampling.paired_bootstrap(df.limit(0), "y", "p", "q").count() == 0
    assert resampling.bootstrap_ci(df.where("y = 1"), "y", "p", replicates=20).count() == 0  # one class
