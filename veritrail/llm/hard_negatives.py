"""Hard negatives by exact integer products in a residue number system.

Components become the integers floor(scale * x). Two matrices of them are multiplied modulo several primes
below 252, each product a float32 GEMM over balanced residues and 1024 dimensions at a time, so every partial
sum is an integer below 2**24 and exact. Garner's form of the Chinese remainder theorem with balanced digits
gives the signed scores back; there are as many primes as the largest components of the two blocks ask for.

Rows are stored in blocks of ``BLOCK_ROWS``, sorted by label within each task, with the range of their labels.
Blocks of anchors meet blocks of rows over a grid: anchors are copied to each column and rows to each row of
the grid, whose shape keeps both sorts of copies few, and they are joined by the cell. A first pass keeps each
anchor's best rows of its label (its positives), a second one the best rows of other labels within each
positive's window; blocks whose labels leave nothing to find are not joined. Tasks keep the running best of an
anchor over all blocks they see, so a window by anchor gets ``k`` rows a cell and not a block.

Defined results: rows whose id, label, vector or any component is null, or which hold a non-finite component, take no
part. Equal rows count once; rows of one id with other labels or vectors are rows of their own, and those that
share an anchor's id are never its positives or negatives. Shorter vectors count as if filled up with zeros; an
empty vector has the score 0 with every row. Components beyond 2**140 count as that number, and a score beyond a
long as the end of its range. A positive with a negative score has an empty window. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK_ROWS, ANCHOR_ROWS = 4096, 512
#: Dimensions whose products of balanced residues stay below 2**24, and blocks of anchors a task keeps the best of.
EXACT_DIMENSIONS, HELD_BLOCKS = 1024, 64
LARGEST = 2.0**140
_NONE = np.iinfo(np.int64).min
_END = np.iinfo(np.int64).max
_BLOCK = "block long, n int, dim int, least long, most long, bytes int, keys binary, ids binary, labels binary, parts binary"


@cache
def primes(bound: int) -> tuple[int, ...]:
    """Primes below 252, from the largest, whose product exceeds twice ``bound``."""
    out: list[int] = []
    for p in range(251, 2, -2):
        if prod(out) > 2 * bound:
            break
        if all(p % q for q in range(3, 16, 2) if q < p):
            out.append(p)
    return tuple(out)


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` in -p/2..p/2; twice, as the first quotient of a large number may be off by one."""
    one = np.float32(1 / p)
    x = x - np.rint(x * one) * np.float32(p)
    return x - np.rint(x * one) * np.float32(p)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two float64 matrices of integers, as int64 (beyond it: the end of the range)."""
    m, n, d = len(a), len(b), a.shape[1]
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    most = lambda x: int(np.abs(x).max())
    chosen = primes(d * most(a) * most(b))
    digits: list[np.ndarray] = []
    for p in chosen:
        x, y = (_balanced(np.fmod(z, p).astype(np.float32), p) for z in (a, b))
        r = np.zeros((m, n), np.float32)
        for k in range(0, d, EXACT_DIMENSIONS):
            r = _balanced(r + _balanced(x[:, k : k + EXACT_DIMENSIONS] @ y[:, k : k + EXACT_DIMENSIONS].T, p), p)
        for q, digit in zip(chosen, digits):
            r = _balanced((r - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(r)
    if prod(chosen).bit_length() <= 63:
        out, unit = np.zeros((m, n), np.int64), 1
        for p, digit in zip(chosen, digits):
            out += digit.astype(np.int64) * unit
            unit *= p
        return out
    wide, unit = np.zeros((m, n), object), 1
    for p, digit in zip(chosen, digits):
        wide += digit.astype(np.int64).astype(object) * unit
        unit *= p
    return np.clip(wide, -_END, _END).astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """key, vec_id, label and vec of the rows that take part."""
    v = F.col(vector_col)
    v = v if df.schema[vector_col].dataType.elementType.typeName() in ("float", "double") else v.cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vec")).distinct()
    return rows.select(F.xxhash64("vec_id", "label", "vec").alias("key"), "vec_id", "label", "vec")


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Integer components as float64, rows filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), -LARGEST, LARGEST)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def blocked(rows: DataFrame, size: int, scale: float, name: str) -> DataFrame:
    """Blocks of ``size`` rows at most, stored. Columns after vec travel as one binary column each, of longs."""
    more = rows.columns[4:]
    schema = _BLOCK + "".join(f", {c} binary" for c in more)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                key, ids, label = (piece.column(k).to_numpy().astype(np.int64) for k in range(3))
                x = _matrix(piece.column(3), scale)
                order = np.argsort(ids, kind="stable")
                narrow = bool((np.abs(x) < 2**24).all())
                binary = [key[order], ids[order], label[order], x[order].astype(np.float32 if narrow else np.float64)]
                binary += [np.stack(piece.column(c).to_numpy(zero_copy_only=False)).astype(np.int64)[order] for c in more]
                head = [pa.array([v], k) for v, k in ((int(key[0]), pa.int64()), (len(ids), pa.int32()), (x.shape[1], pa.int32()), (int(label.min()), pa.int64()), (int(label.max()), pa.int64()), (4 if narrow else 8, pa.int32()))]
                yield pa.RecordBatch.from_arrays(head + [pa.array([v.tobytes()], pa.binary()) for v in binary], names=["block", "n", "dim", "least", "most", "bytes", "keys", "ids", "labels", "parts", *more])

    return stored(rows.sortWithinPartitions("label", "vec_id").mapInArrow(task, schema), name)


def grid(rows: int, anchors: int, tasks: int) -> tuple[int, int]:
    """Columns and rows of a grid of about ``tasks`` cells that copies anchors and rows least."""
    down = min(max(1, round((tasks * anchors / max(rows, 1)) ** 0.5)), max(anchors, 1))
    return min(max(1, ceil(tasks / down)), max(rows, 1)), down


def meet(rows: DataFrame, anchors: DataFrame, where) -> DataFrame:
    """Pairs of an anchors' block (columns a_...) and a rows' block for which ``where`` holds."""
    spark = rows.sparkSession
    across, down = grid(rows.count(), anchors.count() * ANCHOR_ROWS // BLOCK_ROWS + 1, 4 * spark.sparkContext.defaultParallelism)
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns), number(down).alias("down"), cells(across).alias("across"))
    b = rows.select("*", number(across).alias("across"), cells(down).alias("down"))
    n = across * down
    return a.repartition(n, "across", "down").join(b.repartition(n, "across", "down"), ["across", "down"]).where(where).drop("across", "down")


class Best:
    """The ``k`` best (score, id) of each anchor of a block and each of its windows, over rows' blocks."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), _NONE)
        self.id = np.full((*low.shape, k), _END)

    def add(self, score: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """``fits``: the anchor may take the row; columns stand in the order of their ids."""
        k, n = self.k, len(ids)
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[:, w], self.score[:, w, k - 1])
            hit = fits & (score >= floor[:, None]) & (score <= self.high[:, w, None])
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            held = np.where(hit[some], score[some], _NONE)
            if n > k:  # not below the k-th best of this block
                held[held < np.partition(held, n - k, axis=1)[:, n - k, None]] = _NONE
            r, c = np.nonzero(held > _NONE)
            r, s, i = (np.concatenate(x) for x in ((np.repeat(np.arange(len(some)), k), r), (self.score[some, w].ravel(), held[r, c]), (self.id[some, w].ravel(), ids[c])))
            order = np.lexsort((i, np.invert(s), r))  # ~s falls as s rises, for every long
            r, s, i = r[order], s[order], i[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < k
            self.score[some[r[top]], w, place[top]], self.id[some[r[top]], w, place[top]] = s[top], i[top]


def _search(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """key, anchor_id, window, id, score: the best ``k`` of each cell, of the anchor's own label or of others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}

        def told(block: int) -> pa.RecordBatch:
            keys, ids, b = best.pop(block)
            r, w, p = np.nonzero(b.score > _NONE)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[r], ids[r], w.astype(np.int32), b.id[r, w, p], b.score[r, w, p])], names=["key", "anchor_id", "window", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, of=batch, at=row: of.column(name)[at].as_py()
                longs = lambda name: np.frombuffer(get(name), np.int64)
                matrix = lambda p, dim: np.pad(np.frombuffer(get(p + "parts"), np.float32 if get(p + "bytes") == 4 else np.float64).reshape(get(p + "n"), get(p + "dim")).astype(np.float64), ((0, 0), (0, dim - get(p + "dim"))))
                dim, block, own = max(get("dim"), get("a_dim")), get("a_block"), longs("a_ids")
                if block not in best:
                    if len(best) >= HELD_BLOCKS:
                        yield told(next(iter(best)))
                    if same:
                        low, high = np.full((len(own), 1), -_END), np.full((len(own), 1), _END)
                    else:
                        low, high = longs("a_low").reshape(len(own), -1), longs("a_high").reshape(len(own), -1)
                    best[block] = (longs("a_keys"), own, Best(low, high, k))
                ids = longs("ids")
                fits = ((longs("a_labels")[:, None] == longs("labels")) == same) & (own[:, None] != ids)
                if fits.any():
                    best[block][2].add(products(matrix("a_", dim), matrix("", dim)), fits, ids)
        for block in list(best):
            yield told(block)

    return pairs.mapInArrow(task, "key long, anchor_id long, window int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key", "anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score.

    ``rows``: what ``usable`` gives; ``is_anchor``: a condition on vec_id and label. For each of an anchor's best
    ``positives`` rows of its own label, the first ``negatives`` rows of other labels whose score, times 100,
    lies between ``low`` and ``high`` times the positive's. Ties go to the smaller id.
    """
    rows = stored(rows, "negatives-rows")
    anchors = rows.where(is_anchor)
    blocks = blocked(rows, BLOCK_ROWS, scale, "negatives-blocks")
    first = blocked(anchors, ANCHOR_ROWS, scale, "negatives-anchors")
    found = _search(meet(blocks, first, "a_least <= most AND least <= a_most"), positives, same=True)
    kept = stored(_ranked(found, positives).select("key", "anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # windows as longs: least score and greatest score; one that is empty asks for more than it allows
    p = F.col("positive_score").cast("decimal(38,0)")
    edge = lambda share, up: (F.ceil if up else F.floor)(p * share / 100).cast("long")
    windows = kept.where("positive_score >= 0").select("key", F.col("window"), edge(low, True).alias("low"), edge(high, False).alias("high"))
    by_place = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.map_from_entries("w")[i][c], F.lit(none)))
    windows = windows.groupBy("key").agg(F.collect_list(F.struct("window", F.struct("low", "high"))).alias("w")).select("key", by_place("low", 1).alias("low"), by_place("high", 0).alias("high"))
    second = blocked(anchors.join(windows, "key"), ANCHOR_ROWS, scale, "negatives-windows")
    others = _search(meet(blocks, second, "NOT (least = most AND a_least = a_most AND least = a_least)"), negatives, same=False)
    ranked = _ranked(others.withColumn("window", F.col("window") + 1), negatives).select("key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(kept, ["key", "window"]).select("anchor_id", F.col("window").alias("positive_rank"), "positive_id", "positive_score", "rank", "negative_id", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every row whose vec_id is divisible by 100, after the labels of every seventh id are moved."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = table.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    found = mine(usable(moved, "vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
