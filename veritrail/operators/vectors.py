"""Exact nearest rows by inner product: blocks of queries against blocks of rows, best ``k`` kept in each task.

Blocks are cut in the tasks that read the rows. They meet by the cells of a grid (an equality of numbers, no nested
loop); a task keeps the running best of each block of queries, and passes on ``k`` rows a query and cell, so
what is shuffled for the last ranking does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS, HELD_BLOCKS = 4096, 256, 128
_NO_ID = np.iinfo(np.int64).max


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` rows at most of (id: long, vector: array<double>), rows sorted by id; all vectors of one length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                ids = piece.column(0).to_numpy().astype(np.int64)
                order = np.argsort(ids, kind="stable")
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[order[0]])]), pa.array([ids[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())], names=["block", "ids", "x"])

    return rows.mapInArrow(task, "block long, ids binary, x binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of dimension."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += a[:, d, None] * b[None, :, d]
    return out


class Best:
    """The ``k`` best (score, id) of each query, over blocks; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), _NO_ID)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        k, n = self.k, len(ids)
        hit = score >= self.score[:, k - 1, None]
        if n > k:
            hit &= score >= np.partition(score, n - k, axis=1)[:, n - k, None]
        hit &= score > -np.inf
        r, c = np.nonzero(hit)
        old, place = np.nonzero(self.id < _NO_ID)
        r, s, i = np.concatenate((old, r)), np.concatenate((self.score[old, place], score[r, c])), np.concatenate((self.id[old, place], ids[c]))
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        self.score[r[top], place[top]], self.id[r[top], place[top]] = s[top], i[top]


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the ``k`` rows of ``corpus`` with the largest products; a query does not find its own id.

    Both: id (long), vector (array<double>), all of one length.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, Best]] = {}

        def told(block: int) -> pa.RecordBatch:
            own, b = best.pop(block)
            r, p = np.nonzero(b.id < _NO_ID)
            return pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(b.id[r, p]), pa.array(b.score[r, p])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind, of=batch, at=row: np.frombuffer(of.column(name)[at].as_py(), kind)
                block, own, ids = batch.column("q_block")[row].as_py(), get("q_ids", np.int64), get("ids", np.int64)
                if block not in best:
                    if len(best) >= HELD_BLOCKS:
                        yield told(next(iter(best)))
                    best[block] = (own, Best(len(own), k))
                score = products(get("q_x", np.float64).reshape(len(own), -1), get("x", np.float64).reshape(len(ids), -1))
                score[own[:, None] == ids] = -np.inf
                best[block][1].add(score, ids)
        for block in list(best):
            yield told(block)

    rows, asked = blocks(corpus, BLOCK_ROWS), blocks(queries, QUERY_ROWS)
    # a grid of cells: rows are copied to each of its rows, queries to each of its columns
    tasks, n_rows, n_asked = 2 * corpus.sparkSession.sparkContext.defaultParallelism, corpus.count(), queries.count()
    down = max(1, min(ceil(n_asked / QUERY_ROWS), round((tasks * n_asked / max(n_rows, 1)) ** 0.5)))
    across = max(1, min(ceil(n_rows / BLOCK_ROWS), ceil(tasks / down)))
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), number(down).alias("down"), every(across).alias("across"))
    b = rows.select("ids", "x", number(across).alias("across"), every(down).alias("down"))
    cells = across * down
    pairs = a.repartition(cells, "across", "down").join(b.repartition(cells, "across", "down"), ["across", "down"]).drop("across", "down")
    found = pairs.mapInArrow(task, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
