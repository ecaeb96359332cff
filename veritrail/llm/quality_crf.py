"""Quality classifier: a linear-chain CRF labels every line of a text good or bad.

A line's features are its own shape (length, capitals, symbols, repeated words, ...) and the same
shape of the line before and after it. Forward-backward gives each line's probability of being good;
a text's score is their mean, weighted by the lines' bytes (an empty line counts as one byte).

Training: lines take their document's label, so the chain learns that neighbours agree. It is fitted
on at most ``SAMPLE_DOCS`` labelled documents (those with the smallest md5 of the id), by Adam on the
exact log-likelihood, on the driver; scoring is one Arrow pass over the texts.

Defined results: null and empty texts are one empty line; documents without usable labels to learn
from (none, or of one class only) give a constant score, the share of label 1 (0.5 without labels);
repeated rows score alike; rows of ``labels`` with a null id or label are ignored, an id labelled
twice counts as the rounded mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, Words, chunks, column_bytes, released, small_batches

SAMPLE_DOCS = 4000
#: Lines of them at most (312 bytes each on the driver).
SAMPLE_LINES = 200_000
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)  # 0: other bytes
_CLASS[65:91] = 1  # capitals
_CLASS[97:123] = 2  # small letters
_CLASS[48:58] = 3  # digits
for _c in b"#$%&*|@^~<>{}[]\\=+_/`":
    _CLASS[_c] = 4  # symbols
_CLASS[ord("!")] = 5
for _c in b".,;:'\"-()?":
    _CLASS[_c] = 6
_CLASS[128:] = 7  # bytes of other letters
_CUTS = {1: (0.1, 0.4), 3: (0.05, 0.2), 4: (0.01, 0.05, 0.15), 5: (0.01, 0.05), 6: (0.1,)}
#: Features of one line before its neighbours' are added.
N_OWN = 7 + 4 + sum(map(len, _CUTS.values())) + 4


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with neighbours (lines x 3 N_OWN + 3), bytes of each line, lines of each text."""
    newline = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(newline, offsets)) + 1
    starts = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    last = np.cumsum(per_text) - 1
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[last] = offsets[1:]
    size = ends - starts
    kind = _CLASS[data]
    share = np.zeros((len(starts), 8))
    for c in range(1, 8):
        total = np.concatenate(([0], np.cumsum(kind == c)))
        share[:, c] = (total[ends] - total[starts]) / np.maximum(size, 1)
    words = Words(data, np.concatenate((starts, offsets[-1:])), SPACES)
    n = words.count
    order = np.lexsort((words.hash, words.text))
    h, t = words.hash[order], words.text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[fresh], minlength=len(starts))
    same = np.zeros(len(h), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    adjacent = np.bincount(words.text[same], minlength=len(starts)) / np.maximum(n, 1)
    variety = np.where(n, distinct / np.maximum(n, 1), 1.0)
    letters = share[:, 1] + share[:, 2]
    capital = np.where(letters > 0, share[:, 1] / np.maximum(letters, 1e-9), 0)
    parts = [share[:, 1:8], np.log1p(size)[:, None] / 6, np.log1p(n)[:, None] / 6, variety[:, None], adjacent[:, None]]
    parts += [(share[:, c] > cut)[:, None] for c, cuts in _CUTS.items() for cut in cuts]
    parts += [x[:, None] for x in (capital > 0.6, variety < 0.5, adjacent > 0.2, n == 0)]
    own = np.concatenate(parts, axis=1).astype(np.float32)
    first = last - per_text + 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 3), np.float32)
    edge[:, 0], edge[first, 1], edge[last, 2] = 1, 1, 1
    return np.concatenate((own, before, after, edge), axis=1), size, per_text


def forward_backward(emit: np.ndarray, per_text: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of each line being good, expected transitions (2 x 2), and the sum of log Z.

    ``emit``: score of good against bad for each line; texts lie one after the other.
    Texts are worked on together, line number by line number.
    """
    order = np.argsort(-per_text, kind="stable")
    start = (np.cumsum(per_text) - per_text)[order]
    longest = int(per_text.max(initial=0))
    active = np.searchsorted(-per_text[order], -np.arange(longest), side="left")
    alpha = np.zeros((len(emit), 2))
    beta = np.zeros((len(emit), 2))
    alpha[start, 1] = emit[start]
    for t in range(1, longest):
        at = start[: active[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[at, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + emit[at]
    ends = start + per_text[order] - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        n = active[t]
        at, z = start[:n] + t, log_z[:n]
        b0, b1 = beta[at, 0], beta[at, 1] + emit[at]
        a = alpha[at - 1]
        for y in (0, 1):
            pairs[y, 0] += np.exp(a[:, y] + trans[y, 0] + b0 - z).sum()
            pairs[y, 1] += np.exp(a[:, y] + trans[y, 1] + b1 - z).sum()
        beta[at - 1, 0] = np.logaddexp(trans[0, 0] + b0, trans[0, 1] + b1)
        beta[at - 1, 1] = np.logaddexp(trans[1, 0] + b0, trans[1, 1] + b1)
    every = np.empty(len(emit))
    every_at = np.repeat(start, per_text[order]) + np.arange(len(emit)) - np.repeat(np.cumsum(per_text[order]) - per_text[order], per_text[order])
    every[every_at] = np.repeat(log_z, per_text[order])
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - every, 0))
    return good, pairs, float(log_z.sum())


class Model:
    """Weights of the emission features and the 2 x 2 transition scores; or a constant."""

    def __init__(self, weights: np.ndarray | None, trans: np.ndarray | None, constant: float = 0.5):
        self.weights, self.trans, self.constant = weights, trans, constant

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of being good and bytes of each line, lines of each text."""
        x, size, per_text = line_features(data, offsets)
        if self.weights is None:
            return np.full(len(size), self.constant), size, per_text
        good, _, _ = forward_backward(x @ self.weights, per_text, self.trans)
        return good, size, per_text

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0)
        good, size, per_text = self.lines(data, offsets)
        weight = np.maximum(size, 1)
        text = np.repeat(np.arange(len(per_text)), per_text)
        return np.clip(np.bincount(text, good * weight) / np.bincount(text, weight), 0, 1)


def train(x: np.ndarray, per_text: np.ndarray, label: np.ndarray, steps: int = 150, l2: float = 1e-3) -> Model:
    """Adam on the log-likelihood per line of whole chains; label: one of 0 and 1 for each text."""
    if len(label) == 0 or label.min() == label.max():
        return Model(None, None, float(label.mean()) if len(label) else 0.5)
    y = np.repeat(label, per_text).astype(float)
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = (per_text[label == v] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, trans = theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(x @ w, per_text, trans)
        grad = np.concatenate(((y - good).astype(np.float32) @ x, (seen - pairs).ravel())) / len(y) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled ids of ``labels`` (doc_id, ``label_col``), those with the smallest
    md5, and of their texts on at most ``SAMPLE_LINES`` lines (a text that does not fit is passed over); of rows with
    one id on the least text."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("int").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    order = (F.md5(F.col("doc_id").cast("string")), "doc_id")
    sizes = texts.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    few, total = [], 0
    for r in sizes.orderBy(*order).collect():  # sample_docs rows at most
        if total + r.lines <= SAMPLE_LINES:  # a text that does not fit is left out, the next ones may
            few.append((r.doc_id,))
            total += r.lines
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(few, sizes.select("doc_id").schema)), "doc_id", "left_semi")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            for a, b in chunks(np.diff(offsets)):
                x, _, per_text = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(per_text)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], batch["y"][a:b], pa.array(per_text, pa.int32()), pa.array([x[e - n : e].tobytes() for n, e in zip(per_text, ends)], pa.binary())],
                    names=["doc_id", "y", "n", "x"],
                )

    rows = texts.mapInArrow(features, "doc_id long, y int, n int, x binary").orderBy("doc_id", "x").collect()
    width = 3 * N_OWN + 3
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, width)
    return train(x, np.array([r.n for r in rows], int), np.array([r.y for r in rows], int))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the quality of its whole ``text``."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        data, offsets = column_bytes(texts)
        found = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(np.diff(offsets))]
        released()
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(out, of_text(F.col("text")))


def held_out(mod: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == remainder, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: score every document; labels with crc32 remainder 2 (of 4) are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out(4, 2)))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents scored at ``THRESHOLD`` or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out(4, 2)))
    return score(docs, model, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")
