"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is coded as a sum of one codeword from each of ``BOOKS`` codebooks, all over the full
dimension. Codebooks are fitted by k-means on what the earlier books leave over, on at most
``SAMPLE_ROWS`` vectors (those with the smallest hash), on the driver. Every row is then coded by a
beam search over the books, and stored in blocks of at most ``BLOCK_ROWS`` rows with its codes and the
norm of what the code leaves over.

Search works on a block of queries against a block of rows: lookup tables (query x codeword) give
each row's approximate product; adding the query's norm times the stored norm gives a bound that no
exact product passes. The ``RERANK`` best rows of a block by approximate product are scored exactly
on the original vectors, in double precision, summed in order of dimension. With ``certify``, so are
all further rows whose bound passes the query's ``k``-th exact score; as a row whose bound does not
pass it cannot be among the ``k`` nearest, the result is then exact (worth it only where the codes are
close, since else most bounds pass). The best ``k`` of each pair of blocks are merged by a window.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and rows with a
null id, take no part; rows of a dimension other than the most frequent one take no part either; a
query that occurs twice with equal vectors is asked once; rows that share the query's id are its own.
Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

BOOKS = 20
WORDS = 64
BEAM = 4
SAMPLE_ROWS = 8192
BLOCK_ROWS = 4096
QUERY_ROWS = 512
RERANK = 160
_BLOCK = "block long, n int, ids binary, vectors binary, codes binary, rest binary"


class Codebooks:
    """books: BOOKS x WORDS x dimension, float32."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x books, uint8) and the norm of what they leave over."""
        n, dim = x.shape
        left = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            b = left.shape[1]
            # distance after taking a word away, up to the norm of what is left
            cost = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, b, len(book)) + (book * book).sum(1)
            cost = cost.reshape(n, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            at, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, at[:, :, None], 1) - book[word]
            codes = np.concatenate((np.take_along_axis(codes, at[:, :, None], 1), word[:, :, None].astype(np.uint8)), axis=2)
        norms = np.sqrt((left.astype(np.float64) ** 2).sum(2))
        best = norms.argmin(1)[:, None]
        return np.take_along_axis(codes, best[:, :, None], 1)[:, 0], np.take_along_axis(norms, best, 1)[:, 0]


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8) -> Codebooks:
    """k-means on residuals, from a fixed seed."""
    rng = np.random.default_rng(11)
    left, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        centre = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((centre * centre).sum(1) - 2 * left @ centre.T).argmin(1)
            order = np.argsort(near, kind="stable")
            used, first, count = np.unique(near[order], return_index=True, return_counts=True)
            centre[used] = np.add.reduceat(left[order], first) / count[:, None]
        near = ((centre * centre).sum(1) - 2 * left @ centre.T).argmin(1)
        left -= centre[near]
        out.append(centre)
    return Codebooks(np.stack(out))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of the rows that take part; the dimension is the most frequent one."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>").alias("vec"))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (size["d"] if size else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)


def index(rows: DataFrame, books: Codebooks, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of coded rows, stored. Rows need no shuffle: each task cuts its own into blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                n = piece.num_rows
                ids, x = piece.column(0).to_numpy().astype(np.int64), _matrix(piece.column(1), n)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                codes, rest = [], []
                for k in range(0, n, 512):
                    c, r = books.encode(x[k : k + 512])
                    codes.append(c)
                    rest.append(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part * 2**32 + number]), pa.array([n], pa.int32())] + [pa.array([v.tobytes()], pa.binary()) for v in (ids, x, np.concatenate(codes), np.concatenate(rest))],
                    names=["block", "n", "ids", "vectors", "codes", "rest"],
                )
                number += 1

    return stored(rows.mapInArrow(task, _BLOCK), "aq-index")


def _query_blocks(queries: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                piece = batch.slice(at, QUERY_ROWS)
                ids, x = piece.column(0).to_numpy().astype(np.int64), _matrix(piece.column(1), piece.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["q_ids", "q_vectors"])

    return queries.mapInArrow(task, "q_ids binary, q_vectors binary")


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of paired rows in double precision, summed in order of dimension."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d].astype(np.float64) * x[:, d]
    return out


def search_block(books: np.ndarray, q_ids, q, ids, x, codes, rest, k: int, rerank: int, certify: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, exact score) of the best k of one block of rows for each query."""
    # of equal vectors only the k + 1 smallest ids can count; copies must not crowd out the rest
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    place = np.arange(len(same)) - np.searchsorted(same[order], same[order])
    kept = np.sort(order[place <= k])
    back, ids, x, codes, rest = kept, ids[kept], x[kept], codes[kept], rest[kept]
    n, nq = len(ids), len(q_ids)
    rerank = min(max(rerank, k), n)
    table = np.einsum("qd,bwd->bqw", q, books)
    near = np.zeros((nq, n), np.float32)
    for b in range(len(books)):
        near += table[b][:, codes[:, b]]
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    # equal approximations go to the smaller row, which has the smaller id
    keyed = near.astype(np.float64) - np.arange(n) * 1e-10
    best = np.argpartition(-keyed, rerank - 1, axis=1)[:, :rerank] if rerank < n else np.broadcast_to(np.arange(n), (nq, n))
    qi, ri = np.repeat(np.arange(nq), best.shape[1]), best.ravel()
    other = q_ids[qi] != ids[ri]
    qi, ri = qi[other], ri[other]
    score = _exact(q[qi], x[ri])
    if certify and rerank < n:
        exact = np.full((nq, n), -np.inf)
        exact[qi, ri] = score
        floor = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        slack = 1e-4 * norm * np.sqrt((x.astype(np.float64) ** 2).sum(1)).max()  # rounding of the tables
        more = (near + norm[:, None] * rest[None, :] + slack[:, None] >= floor[:, None]) & np.isneginf(exact) & ~np.isneginf(near)
        mq, mr = np.nonzero(more)
        qi, ri, score = np.concatenate((qi, mq)), np.concatenate((ri, mr)), np.concatenate((score, _exact(q[mq], x[mr])))
    order = np.lexsort((ids[ri], -score, qi))
    qi, ri, score = qi[order], ri[order], score[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    top = place < k
    return qi[top], back[ri[top]], score[top]


def search(blocks: DataFrame, queries: DataFrame, books: Codebooks, k: int = 20, rerank: int = RERANK, certify: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``blocks`` for each row of ``queries``."""
    table, dim = books.books, books.books.shape[2]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind, row=r, of=batch: np.frombuffer(of.column(name)[row].as_py(), kind)
                q_ids, ids = get("q_ids", np.int64), get("ids", np.int64)
                x = get("vectors", np.float32).reshape(-1, dim)
                qi, ri, score = search_block(table, q_ids, get("q_vectors", np.float32).reshape(-1, dim), ids, x, get("codes", np.uint8).reshape(len(ids), -1), get("rest", np.float64), k, rerank, certify)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(ids[ri]), pa.array(score)], names=["query_id", "vec_id", "score"])

    # every block of queries meets every block of rows; pairs are dealt out evenly
    pairs = blocks.repartition("block").crossJoin(_query_blocks(queries))
    found = pairs.mapInArrow(task, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Codebooks | None:
    """Codebooks from at most ``sample_rows`` rows; None if there is none."""
    sample = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample_rows).select("vec").collect()
    return train(np.array([r.vec for r in sample], np.float32)) if sample else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every row whose vec_id is divisible by 20."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(F.col("vec_id") % 20 == 0).dropDuplicates()
    return search(index(rows, books), queries, books)


ORACLE = """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * e.embedding[i]::DOUBLE)) AS score
      FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
