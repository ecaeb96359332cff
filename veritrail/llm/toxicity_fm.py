"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words (ASCII marks and spaces separate them, A-Z lower-cased) and the first five
bytes of longer words, hashed to 64 bits.
Of the terms in a bounded sample of labelled texts, the ``N_TERMS`` whose presence tells most about
the label (chi-square, counted by Spark) are the features; so a term's column is not shared with rare
words of the corpus. The machine scores presence: bias + sum of weights + sum over pairs of the dot
products of their factors, so that two terms together can mean more than their weights add up to.

Training: at most ``SAMPLE_DOCS`` labelled ids (those with the smallest md5), Adam on the logistic
loss on the driver. Scoring is one Arrow pass over whole texts.

Defined results: null and empty texts have no terms and get the bias alone; without labels, or with
one class only, every text gets the share of label 1 (0.5 without labels); rows of ``labels`` with a
null id or label are ignored, an id labelled twice counts as the rounded mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_crf import held_out
from .shared import MARKS, Words, chunks, column_bytes

SAMPLE_DOCS = 8000
N_TERMS = 4096
FACTORS = 8
THRESHOLD = 0.5
#: The first bytes of a longer word are a term too, for inflected forms.
STEM_BYTES = 5
#: A feature is in so many sampled texts at least.
LEAST_DOCS = 3
#: Least chi-square of a feature; chance alone passes about one term in 10,000.
LEAST_CHI2 = 15.0


def _distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text, as (text, hash)."""
    words = Words(data, offsets, MARKS)
    stems = words.prefixes(STEM_BYTES)
    long = words.end - words.begin > STEM_BYTES
    h, t = np.concatenate((words.hash, stems[long])), np.concatenate((words.text, words.text[long]))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[fresh], h[fresh]


class Model:
    """terms: sorted hashes; w0, w, v: the machine's parameters."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.w0, self.w, self.v = terms, w0, w, v

    def margin(self, text: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """text, col: the features present, by text."""
        out = self.w0 + np.bincount(text, self.w[col], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[col, k]
            out += 0.5 * (np.bincount(text, x, minlength=n) ** 2 - np.bincount(text, x * x, minlength=n))
        return out

    def columns(self, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return text[:0], np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        return text[known], at[known]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.columns(*_distinct_terms(data, offsets)), n), -30, 30)))


def train(terms: np.ndarray, text: np.ndarray, col: np.ndarray, label: np.ndarray, factors: int = FACTORS, steps: int = 300, l2: float = 2e-4) -> Model:
    """text, col: features present, by text; label: 0 or 1 for each text. Adam over all of them; the factors start at small values from a fixed seed."""
    n, d = len(label), len(terms)
    if n == 0 or label.min() == label.max():
        p = np.clip(label.mean() if n else 0.5, 1e-9, 1 - 1e-9)
        return Model(terms[:0], float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, factors)))
    share = label.mean()
    theta = np.zeros(1 + d * (1 + factors))
    theta[0] = np.log(share / (1 - share))
    theta[1 + d :] = np.random.default_rng(7).normal(0, 0.01, d * factors)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = Model(terms, theta[0], theta[1 : 1 + d], theta[1 + d :].reshape(d, factors))
        p = 1 / (1 + np.exp(-np.clip(model.margin(text, col, n), -30, 30)))
        err = (label - p)[text]
        grad = np.empty_like(theta)
        grad[0] = (label - p).sum()
        grad[1 : 1 + d] = np.bincount(col, err, minlength=d)
        by_factor = grad[1 + d :].reshape(d, factors)
        for k in range(factors):
            x = model.v[col, k]
            total = np.bincount(text, x, minlength=n)
            by_factor[:, k] = np.bincount(col, err * (total[text] - x), minlength=d)
        grad /= n
        grad[1:] -= l2 * theta[1:] / np.sqrt(step)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(terms, float(theta[0]), theta[1 : 1 + d], theta[1 + d :].reshape(d, factors))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, n_terms: int = N_TERMS) -> Model:
    """Fit on at most ``sample_docs`` labelled ids of ``labels`` (doc_id, ``label_col``)."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("int").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            for a, b in chunks(np.diff(offsets)):
                text, h = _distinct_terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(np.bincount(text, minlength=b - a))
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["y"][a:b], sets], names=["doc_id", "y", "terms"])

    sets = texts.mapInArrow(terms_of, "doc_id long, y int, terms array<long>")
    totals = sets.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = totals["n"] or 0, totals["n1"] or 0
    if not 0 < n1 < n:
        return train(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.array([1] * n1 + [0] * (n - n1)))
    counted = sets.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("df1"))
    a, b = F.col("df1"), F.col("df") - F.col("df1")
    chi2 = F.pow(a * F.lit(float(n - n1)) - b * F.lit(float(n1)), F.lit(2)) * F.lit(n / n1 / (n - n1)) / (F.col("df") * F.greatest(F.lit(n) - F.col("df"), F.lit(1)))
    best = counted.where((F.col("df") >= LEAST_DOCS) & (chi2 >= LEAST_CHI2)).orderBy(chi2.desc(), "term").limit(n_terms).select("term")
    terms = np.sort(np.array([r.term for r in best.collect()], np.int64).view(np.uint64))
    known = F.broadcast(best.select(F.col("term").alias("known")))
    present = sets.select("doc_id", "y", F.explode("terms").alias("term")).join(known, F.col("term") == F.col("known")).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    rows = sets.select("doc_id", "y").distinct().join(present, "doc_id", "left").orderBy("doc_id").collect()
    text = np.repeat(np.arange(len(rows)), [len(r.terms or ()) for r in rows])
    col = np.searchsorted(terms, np.array([x for r in rows for x in sorted(r.terms or ())], np.int64).view(np.uint64))
    return train(terms, text, col, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the toxicity of its whole ``text``."""

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        data, offsets = column_bytes(texts)
        found = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(np.diff(offsets))]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(out, of_text(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: score every document; labels with crc32 remainder 0 (of 5) are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(5, 0)))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
