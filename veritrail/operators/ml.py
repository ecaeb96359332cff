"""Stacked classifiers, calibration and baselines with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import stored
from . import metrics as M
from .sampling import stratified_kfold

FOLDS, INNER_FOLDS, TREES, ROUNDS = 5, 3, 100, 100
#: Rows of a partition while models are fitted, at least: passes over few rows shouldn't be many tasks. And folds fitted at once.
PARTITION_ROWS, AT_ONCE = 50_000, 6
#: Thresholds among which Youden's is chosen.
THRESHOLDS = [round(0.1 + i / 100, 2) for i in range(81)]
MEMBERS = ("lr", "svm", "rf", "gbt")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


class MarginClassifier:
    """A linear support vector machine whose margins are turned into probabilities.

    The two numbers of the sigmoid come from margins of rows that the machine has not seen: ``inner`` folds of
    the training rows, each scored by a machine fitted on the others. The machine itself is fitted on all of them.
    """

    def __init__(self, key: str, inner: int = INNER_FOLDS, seed: int = 42, reg: float = 0.01):
        self.key, self.inner, self.seed, self.svm = key, inner, seed, LinearSVC(maxIter=30, regParam=reg)

    @staticmethod
    def margins(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("__margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")

    def inner_folds(self, train: DataFrame) -> DataFrame:
        """key, label, features, fold in as many partitions as ``train``.

        The folds are stored first: a task of the few would else hold the sorts of all shuffle partitions that it reads until its end.
        """
        folds = stratified_kfold(train.select(self.key, "label", "features"), self.key, "label", self.inner, self.seed + 1)
        return stored(folds, "inner-folds").coalesce(train.rdd.getNumPartitions())

    def fit(self, train: DataFrame) -> MarginClassifier:
        parts = self.inner_folds(train).persist()
        held = None
        for f in range(self.inner):
            part = self.margins(self.svm.fit(parts.where(F.col("fold") != f)), parts.where(F.col("fold") == f)).select("label", "__margin")
            held = part if held is None else held.unionByName(part)
        held = VectorAssembler(inputCols=["__margin"], outputCol="__m").transform(held)
        sigma = LogisticRegression(featuresCol="__m", maxIter=100).fit(held)
        self.slope, self.offset = float(sigma.coefficients[0]), float(sigma.intercept)
        self.model = self.svm.fit(parts)
        parts.unpersist()
        return self

    def score(self, df: DataFrame, name: str) -> DataFrame:
        return self.margins(self.model, df).withColumn(name, sigmoid(F.col("__margin") * self.slope + self.offset)).drop("__margin")


def _score(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the probability of label 1."""
    if isinstance(model, MarginClassifier):
        return model.score(df, name)
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def _together(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of independent fits; their Spark jobs run side by side."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


@dataclass
class Stack:
    """Members over scaled features, a logistic regression on their out-of-fold probabilities, an isotonic step, a threshold."""

    key: str
    only: tuple[str, ...] = MEMBERS
    trees: int = TREES
    rounds: int = ROUNDS
    seed: int = 42
    members: dict = field(default_factory=dict)

    def _fresh(self, name: str):
        return {
            "lr": lambda: LogisticRegression(maxIter=100, regParam=0.01), "svm": lambda: MarginClassifier(self.key, seed=self.seed),
            "rf": lambda: RandomForestClassifier(numTrees=self.trees, maxDepth=5, seed=self.seed), "gbt": lambda: GBTClassifier(maxIter=self.rounds, maxDepth=3, seed=self.seed),
        }[name]()

    def _scaler(self, rows: DataFrame):
        return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)

    def fit(self, df: DataFrame, label: str, features: str, k: int = FOLDS) -> Stack:
        """``df``: key, label (0 or 1), features (vector). Scaling is fitted on the training folds only.

        ``oof`` then holds key, label, fold, each member's out-of-fold probability, stacked, calibrated and
        predicted; the members and the scaler are fitted again on all rows.
        """
        base = df.select(self.key, F.col(label).cast("double").alias("label"), F.col(features).alias("raw"))
        folds = stored(stratified_kfold(base, self.key, "label", k, self.seed), "folds")
        folds = folds.coalesce(max(1, folds.count() // PARTITION_ROWS)).persist()

        def one(f: int) -> DataFrame | None:
            """Out-of-fold probabilities of fold ``f``; the last number stands for the fit on all rows."""
            rows = folds.where(F.col("fold") != f) if f < k else folds
            scaler = self._scaler(rows)
            train = scaler.transform(rows).persist()
            fitted = {name: self._fresh(name).fit(train) for name in self.only}
            train.unpersist()
            if f == k:
                self.scaler, self.members = scaler, fitted
                return None
            test = scaler.transform(folds.where(F.col("fold") == f))
            for name, model in fitted.items():
                test = _score(model, test, name)
            return stored(test.select(self.key, "label", "fold", *self.only), f"fold-{f}")

        parts = _together(df.sparkSession, [lambda f=f: one(f) for f in range(k + 1)])
        oof = parts[0]
        for part in parts[1:k]:
            oof = oof.unionByName(part)
        oof = oof.coalesce(max(1, oof.count() // PARTITION_ROWS))
        self.meta = LogisticRegression(featuresCol="__in", maxIter=1000).fit(self._inputs(oof))
        stacked = self._stacked(oof).select(self.key, "label", "fold", *self.only, "stacked")
        self.isotonic = IsotonicRegression(featuresCol="stacked", labelCol="label", predictionCol="calibrated").fit(stacked)
        calibrated = self.isotonic.transform(stacked)
        value = F.col("recall") + F.col("specificity") - 1
        self.threshold = M.best_threshold(M.at_thresholds(calibrated, "label", "calibrated", THRESHOLDS), value).first()["best_threshold"]
        self.oof = self._predicted(calibrated)
        folds.unpersist()
        return self

    def _inputs(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.only), outputCol="__in").transform(df)

    def _stacked(self, df: DataFrame) -> DataFrame:
        return _score(self.meta, self._inputs(df), "stacked").drop("__in")

    def _predicted(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted", (F.col("calibrated") >= self.threshold).cast("int"))

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with the members' probabilities, stacked, calibrated and predicted."""
        out = self.scaler.transform(df.withColumn("raw", F.col(features)))
        for name, m in self.members.items():
            out = _score(m, out, name)
        return self._predicted(self.isotonic.transform(self._stacked(out.drop("features", "raw"))))


#: Bounds of a temperature, points tried in each round (evenly in the logarithm), and rounds.
TEMPERATURES, POINTS, REFINED = (0.01, 10.0), 41, 6


def logit_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """z, pos, neg: log-odds of the probabilities, and how many rows of each label have them.

    Rows meet by the probability itself, so the loss of any temperature is a sum over these rows and exact.
    """
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return df.groupBy(F.ln(q / (1 - q)).alias("z")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def losses(counts: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, nll: mean negative log-likelihood at each temperature."""
    s = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), sigmoid(F.col("z") / F.col("temperature"))))
    rows = counts.withColumn("temperature", F.explode(F.array(*map(F.lit, temperatures))))
    total = F.sum(-(F.col("pos") * F.ln(s) + F.col("neg") * F.ln(1 - s)))
    return rows.groupBy("temperature").agg((total / F.sum(F.col("pos") + F.col("neg"))).alias("nll"))


def temperature_scaling(df: DataFrame, y: str, p: str) -> DataFrame:
    """temperature, nll: the temperature of least negative log-likelihood between ``TEMPERATURES``.

    The loss is convex in 1 / temperature, so its minimum lies between the neighbours of the best of some points:
    each round tries points between those, on the counts. One row; none for an empty table.
    """
    counts = stored(logit_counts(df, y, p), "logit-counts")
    low, high = TEMPERATURES
    best = None
    for _ in range(REFINED):
        ratio = (high / low) ** (1 / (POINTS - 1))
        points = [low * ratio**i for i in range(POINTS)]
        tried = sorted(((r.nll, r.temperature) for r in losses(counts, points).collect() if r.nll is not None))
        if not tried:
            break
        best = tried[0] if best is None else min(best, tried[0])
        at = min(range(POINTS), key=lambda i: abs(points[i] - tried[0][1]))
        low, high = points[max(at - 1, 0)], points[min(at + 1, POINTS - 1)]
    return df.sparkSession.createDataFrame([(best[1], best[0])] if best else [], "temperature double, nll double")


def baselines(text: Column, query: Column, key: Column, share: Column) -> dict[str, Column]:
    """Model-free scores: majority (of the counted ``share`` of label 1), uniform, unique-word ratio, query overlap, length, and a blend."""
    w, q = F.split(F.lower(text), r"\s+"), F.split(F.lower(query), r"\s+")
    unique = F.size(F.array_distinct(w)) / F.size(w)
    overlap = F.size(F.array_intersect(w, q)) / F.size(F.array_distinct(q))
    uniform = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":baseline"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    length = F.pmod(F.length(text), F.lit(100)) / 100.0
    return {"majority": (share >= 0.5).cast("double"), "uniform": uniform, "unique_words": unique, "query_overlap": overlap, "length": length, "blend": 0.4 * unique + 0.6 * length}


def out_of_fold(df: DataFrame, key: str, label: str, features: str, estimator=None, k: int = 5, seed: int = 42) -> DataFrame:
    """key, label, fold, score: probabilities of a model (logistic regression by default) fitted on the other folds."""
    base = df.select(key, F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
    folds = stored(stratified_kfold(base, key, "label", k, seed), "folds")
    folds = folds.coalesce(max(1, folds.count() // PARTITION_ROWS)).persist()

    def one(f: int) -> DataFrame:
        model = (estimator or LogisticRegression(maxIter=50, regParam=0.01)).copy().fit(folds.where(F.col("fold") != f))
        return _score(model, folds.where(F.col("fold") == f), "score").select(key, "label", "fold", "score")

    parts = _together(df.sparkSession, [lambda f=f: one(f) for f in range(k)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_systems(df: DataFrame, key: str, label: str, features: str, slices: dict[str, list[int]], k: int = FOLDS, seed: int = 42, only: tuple[str, ...] = ("lr", "rf"), trees: int = TREES) -> DataFrame:
    """system, key, label, fold, stacked, calibrated, predicted: the same folds and stack over slices of the feature vector."""

    def one(name: str, dims: list[int]) -> DataFrame:
        cut = VectorSlicer(inputCol=features, outputCol="__cut", indices=dims).transform(df)
        return Stack(key, only, trees, seed=seed).fit(cut, label, "__cut", k).oof.select(key, "label", "fold", "stacked", "calibrated", "predicted").withColumn("system", F.lit(name))

    parts = _together(df.sparkSession, [lambda n=n, d=d: one(n, d) for n, d in slices.items()])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def probes(df: DataFrame, key: str, label: str, features: str, first: int = 64, k: int = 5, seed: int = 42) -> DataFrame:
    """key, label, majority, lr_probe, boosted_probe, first_dims_probe, spread: fitted baselines out of fold, the share of
    label 1 rounded, and how much a row's features spread (their standard deviation, squashed to 0..1)."""
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    cut = VectorSlicer(inputCol=features, outputCol="__cut", indices=list(range(first))).transform(df)
    lr = out_of_fold(df, key, label, features, k=k, seed=seed).select(key, "label", F.col("score").alias("lr_probe"))
    gbt = out_of_fold(df, key, label, features, GBTClassifier(maxIter=10, maxDepth=3, seed=seed), k, seed).select(key, F.col("score").alias("boosted_probe"))
    few = out_of_fold(cut, key, label, "__cut", k=k, seed=seed).select(key, F.col("score").alias("first_dims_probe"))
    v = vector_to_array(features)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v) - mean * mean)
    own = df.select(key, (spread / (1 + spread)).alias("spread"), F.lit(1.0 if share >= 0.5 else 0.0).alias("majority"))
    return lr.join(gbt, key).join(few, key).join(own, key)


def importance_shares(spark, importances, groups: dict[str, range], top: int = 10) -> DataFrame:
    """group, share of all importance, and its features among the ``top`` most important, in that order (comma-joined)."""
    named = [(name, i, float(importances[i])) for name, dims in groups.items() for i in dims if i < len(importances)]  # one for each dimension
    rows = spark.createDataFrame(named, "group string, feature int, importance double")
    total = sum(x for *_, x in named) or 1.0
    best = {i: place for place, (_, i, _) in enumerate(sorted(named, key=lambda x: (-x[2], x[1]))[:top])}
    listed = spark.createDataFrame(list(best.items()), "feature int, place int")
    g = rows.join(listed, "feature", "left").groupBy("group")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "feature")))), lambda x: x["feature"].cast("string")), ",")
    return g.agg((F.sum("importance") / total).alias("share"), names.alias("top"))
