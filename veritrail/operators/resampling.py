"""Bootstrap intervals by resampling counts.

Rows with equal scores and label are one cell with a count, and a cell's count in a replicate is a Poisson draw
with that mean: the sum of its rows' Poisson(1) draws. A cell's draws for all replicates come from a
counter-based generator keyed by the cell and the seed, so tasks that run again, and two models that share a
cell, see the same ones. Cells are sorted within ranges of the score; each range gives vectors over the replicates
(counts of both classes, pairs in order, counts at the threshold), which add up to the areas once every range
knows what lies beyond it. What reaches the driver is these vectors: ``RANGES`` times the replicates,
whatever the number of rows. Nothing is multiplied by the number of replicates before it is in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

REPLICATES, RANGES = 1000, 64
#: Cells whose draws are held at once.
CELLS_AT_ONCE = 512
METRICS = ("accuracy", "precision", "recall", "f1", "auroc", "average_precision")
_VECTORS = ("pos", "neg", "wins", "tp", "fp")


def cells(df: DataFrame, y: str, scores: list[str], by: str | None = None) -> DataFrame:
    """group, label, n and key of each set of rows with equal scores and label."""
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(group.alias("group"), F.col(y).cast("int").alias("label"), *(F.col(s).cast("double").alias(s) for s in scores))
    return rows.groupBy("group", "label", *scores).agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("group", "label", *scores))


def draws(key: np.ndarray, n: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Counts of some cells (rows) in every replicate (columns)."""
    out = np.empty((len(key), replicates), np.int64)
    for i, (k, mean) in enumerate(zip(key.view(np.uint64).tolist(), n.tolist())):
        out[i] = np.random.Generator(np.random.Philox(key=[k, seed])).poisson(mean, replicates)
    return out


def _tied(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """(group and range, scores, pos, neg) of sorted cells: one row for each distinct score, complete, a piece at a time."""
    held: tuple | None = None  # of the last score, which may go on: place, score, pos, neg
    for batch in batches:
        for at in range(0, batch.num_rows, CELLS_AT_ONCE):
            piece = batch.slice(at, CELLS_AT_ONCE)
            places = list(zip(piece.column("group").to_pylist(), piece.column("range").to_pylist()))
            score, label = piece.column("score").to_numpy(zero_copy_only=False), piece.column("label").to_numpy()
            w = draws(piece.column("key").to_numpy(), piece.column("n").to_numpy(), replicates, seed)
            first = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1] or score[i] != score[i - 1]]
            pos, neg = (np.add.reduceat(w * (label == c)[:, None], first, axis=0) for c in (1, 0))
            place, value = [places[i] for i in first], score[first]
            if held and held[0] == place[0] and held[1] == value[0]:
                pos[0] += held[2]
                neg[0] += held[3]
            elif held:
                yield held[0], np.array([held[1]]), held[2][None], held[3][None]
            held = (place[-1], value[-1], pos[-1], neg[-1])
            done = len(first) - 1
            start = 0
            while start < done:
                end = start + 1
                while end < done and place[end] == place[start]:
                    end += 1
                yield place[start], value[start:end], pos[start:end], neg[start:end]
                start = end
    if held:
        yield held[0], np.array([held[1]]), held[2][None], held[3][None]


def _ranged(c: DataFrame, score: str, falling: bool) -> DataFrame:
    at = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col(score) * RANGES))).cast("int")
    rows = c.where(F.col(score).isNotNull() & F.col("label").isin(0, 1)).select("group", at.alias("range"), F.col(score).alias("score"), "label", "n", "key")
    return rows.repartition("group", "range").sortWithinPartitions("group", "range", F.desc("score") if falling else F.asc("score"))


def range_vectors(c: DataFrame, score: str, threshold: float, replicates: int, seed: int) -> dict[tuple[str, int], dict[str, np.ndarray]]:
    """For each group and range of ``score``: vectors over the replicates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), *(pa.array([sums[v].astype(np.float64).tobytes()], pa.binary()) for v in _VECTORS)], names=["group", "range", *_VECTORS])

        for place, value, pos, neg in _tied(batches, replicates, seed):
            if place != now:
                if now is not None:
                    yield told()
                now, sums = place, {v: np.zeros(replicates) for v in _VECTORS}
            below = np.cumsum(neg, axis=0) - neg + sums["neg"]
            sums["wins"] += (pos * (below + neg / 2)).sum(0)
            high = (value >= threshold)[:, None]
            for name, v in (("pos", pos), ("neg", neg), ("tp", pos * high), ("fp", neg * high)):
                sums[name] = sums[name] + v.sum(0)
        if now is not None:
            yield told()

    rows = _ranged(c, score, falling=False).mapInArrow(task, "group string, range int, " + ", ".join(f"{v} binary" for v in _VECTORS)).collect()
    return {(r.group, r.range): {v: np.frombuffer(r[v]) for v in _VECTORS} for r in rows}


def _precision_sums(c: DataFrame, score: str, above: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], replicates: int, seed: int) -> dict[str, np.ndarray]:
    """For each group the sum of precision over positives, given the counts above each range."""
    known = c.sparkSession.sparkContext.broadcast(above)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tp, fp, total = None, None, None, None
        for place, _, pos, neg in _tied(batches, replicates, seed):
            if place != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([total.tobytes()], pa.binary())], names=["group", "total"])
                now, total = place, np.zeros(replicates)
                tp, fp = known.value[place]
            t, f = np.cumsum(pos, axis=0) + tp, np.cumsum(neg, axis=0) + fp
            total += (pos * (t / np.maximum(t + f, 1))).sum(0)
            tp, fp = t[-1], f[-1]
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([total.tobytes()], pa.binary())], names=["group", "total"])

    out: dict[str, np.ndarray] = {}
    for r in _ranged(c, score, falling=True).mapInArrow(task, "group string, total binary").collect():
        out[r.group] = out.get(r.group, 0) + np.frombuffer(r.total)
    return out


def _areas(vectors: dict[tuple[str, int], dict[str, np.ndarray]]) -> dict[str, dict[str, np.ndarray]]:
    """For each group: totals over its ranges and auroc, over the replicates."""
    out: dict[str, dict[str, np.ndarray]] = {}
    for (group, _), v in sorted(vectors.items()):
        g = out.setdefault(group, {name: np.zeros_like(v["pos"]) for name in _VECTORS})
        g["wins"] = g["wins"] + v["wins"] + v["pos"] * g["neg"]
        for name in ("pos", "neg", "tp", "fp"):
            g[name] = g[name] + v[name]
    for g in out.values():
        both = g["pos"] * g["neg"]
        g["auroc"] = np.divide(g["wins"], both, out=np.full_like(both, 0.5), where=both > 0)
    return out


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b > 0)


def bootstrap_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: str | None = None, replicates: int = REPLICATES, seed: int = 42) -> dict[str, dict[str, np.ndarray]]:
    """For each group the ``METRICS`` of the replicates that hold both classes."""
    c = stored(cells(df, y, [p], by), "cells")
    vectors = range_vectors(c, p, threshold, replicates, seed)
    areas = _areas(vectors)
    above: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for group in areas:
        t = f = np.zeros(replicates)
        for place in sorted((k for k in vectors if k[0] == group), reverse=True):
            above[place] = (t, f)
            t, f = t + vectors[place]["pos"], f + vectors[place]["neg"]
    precise = _precision_sums(c, p, above, replicates, seed) if above else {}
    out = {}
    for group, a in areas.items():
        both = (a["pos"] > 0) & (a["neg"] > 0)
        precision, recall = _shares(a["tp"], a["tp"] + a["fp"]), _shares(a["tp"], a["pos"])
        values = {
            "accuracy": _shares(a["tp"] + a["neg"] - a["fp"], a["pos"] + a["neg"]), "precision": precision, "recall": recall, "f1": _shares(2 * precision * recall, precision + recall),
            "auroc": a["auroc"], "average_precision": _shares(precise[group], a["pos"]),
        }
        out[group] = {m: v[both] for m, v in values.items()}
    return out


def bootstrap_ci(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: str | None = None, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """metric, mean, low (2.5 %), high (97.5 %) over the replicates that hold both classes; a row a group if ``by`` is given."""
    found = bootstrap_metrics(df, y, p, threshold, by, replicates, seed)
    rows = [(g, m, float(v.mean()), *(float(x) for x in np.percentile(v, (2.5, 97.5)))) for g, each in found.items() for m, v in each.items() if len(v)]
    out = df.sparkSession.createDataFrame(rows, "group string, metric string, mean double, low double, high double")
    return out.withColumnRenamed("group", by) if by else out.drop("group")


def paired_bootstrap(df: DataFrame, y: str, p_a: str, p_b: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Difference of AUROC (a less b) on shared draws: mean, interval, and the share of replicates at or below 0 (0.001 at least)."""
    c = stored(cells(df, y, list(dict.fromkeys([p_a, p_b]))), "cells")
    a, b = (_areas(range_vectors(c, p, 0.5, replicates, seed)) for p in (p_a, p_b))
    schema = "delta double, low double, high double, p_value double"
    if not a:
        return df.sparkSession.createDataFrame([], schema)
    d = a[""]["auroc"] - b[""]["auroc"]
    return df.sparkSession.createDataFrame([(float(d.mean()), *(float(x) for x in np.percentile(d, (2.5, 97.5))), max(0.001, float((d <= 0).mean())))], schema)
