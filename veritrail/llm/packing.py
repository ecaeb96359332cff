"""Hierarchical packing of documents into training sequences of several lengths.

Each task encodes its documents, ends each with the end id, and keeps pieces in a pool by length. Documents
longer than the longest window give whole windows and a rest; everything else is one piece. A pool of
``CELL_TOKENS`` is packed from the longest tier down: a piece opens a window of the smallest tier that holds it,
and the gap takes the longest pool pieces that fit; what then stays open is closed by cutting the shortest
piece that is longer than the gap, whose rest goes back to the pool. So a task has at most one open window a
tier at any time. What is left at its end is laid in one row, cut into the longest windows, and the last of
them into powers of two, which need no padding.

Sequences gather in step groups of ``STEP_TOKENS`` tokens, of one length each; what is left of these at a task's end
is grouped from the longest down, so only a task's last group may be smaller.

No shuffle: a task packs what it reads, in memory bounded by the pool, one piece of texts and the ids of the longest
document. Sequence and group numbers hold the partition's number, so a task that runs again gives the same ones.

Defined results: a null or empty text is a document of its end id alone; repeated rows are documents of their
own; other columns are left out, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PIECE_BYTES, default_path, vocabulary
from .shared import chunks

TIERS = (256, 512, 1024, 2048)
END_ID = 1
CELL_TOKENS = 1 << 18
STEP_TOKENS = 16 * 2048
#: Part of a sequence's or group's number that a task counts itself.
COUNTED_BITS = 40

#: A piece: number of the document within the task, its first id's place there, and its ids.
Piece = tuple[int, int, np.ndarray]


class Pool:
    """Pieces by length; finds the longest up to a length and the shortest above it."""

    def __init__(self) -> None:
        self.by_length: defaultdict[int, list[Piece]] = defaultdict(list)
        self.lengths = 0  # bit n: there is a piece of n ids
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = len(piece[2])
        if n:
            self.by_length[n].append(piece)
            self.lengths |= 1 << n
            self.tokens += n

    def _take(self, n: int) -> Piece:
        held = self.by_length[n]
        piece = held.pop()
        if not held:
            self.lengths ^= 1 << n
        self.tokens -= n
        return piece

    def longest(self, most: int) -> Piece | None:
        n = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        return self._take(n) if n > 0 else None

    def shortest_above(self, n: int) -> Piece | None:
        above = self.lengths >> (n + 1)
        return self._take((above & -above).bit_length() + n) if above else None


def fill(pool: Pool, pieces: list[Piece], size: int) -> int:
    """Fill a window that holds ``pieces`` up to ``size`` from the pool; what stays open."""
    gap = size - sum(len(p[2]) for p in pieces)
    while gap and (piece := pool.longest(gap)):
        pieces.append(piece)
        gap -= len(piece[2])
    if gap and (piece := pool.shortest_above(gap)):
        doc, start, ids = piece
        pieces.append((doc, start, ids[:gap]))
        pool.put((doc, start + gap, ids[gap:].copy()))
        gap = 0
    return gap


def packed(pool: Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[Piece]]]:
    """Full windows (size, pieces), from the longest tier down; pieces of windows that stay open return to the pool."""
    back: list[Piece] = []
    for below, size in reversed(list(zip((0, *tiers), tiers))):
        while pool.lengths >> (below + 1) and (piece := pool.longest(size)):
            pieces = [piece]
            if fill(pool, pieces, size):
                back += pieces
            else:
                yield size, pieces
    for piece in back:
        pool.put(piece)


def leftovers(pool: Pool, longest: int) -> Iterator[tuple[int, list[Piece]]]:
    """What a pool still holds, in one row, as windows of ``longest`` and powers of two."""
    size, pieces, gap = 0, [], 0
    left = pool.tokens
    while left or gap:
        if not gap:
            size = gap = min(longest, 1 << (left.bit_length() - 1))
        piece = pool.longest(longest)
        doc, start, ids = piece
        pieces.append((doc, start, ids[:gap]))
        if len(ids) > gap:
            pool.put((doc, start + gap, ids[gap:]))
        took = min(gap, len(ids))
        gap, left = gap - took, left - took
        if not gap:
            yield size, pieces
            pieces = []


class Steps:
    """Deals sequences out to groups of equal tokens: of one length while there are enough of it."""

    def __init__(self, tokens: int):
        self.tokens, self.number = tokens, 0
        self.waiting: defaultdict[int, list] = defaultdict(list)

    def add(self, size: int, sequence) -> list[tuple[int, int, object]]:
        held = self.waiting[size]
        held.append(sequence)
        if len(held) * size < self.tokens:
            return []
        del self.waiting[size]
        self.number += 1
        return [(self.number - 1, size, s) for s in held]

    def rest(self) -> list[tuple[int, int, object]]:
        """Lengths are powers of two and fall, so each multiple of a group's tokens is met exactly."""
        out, total = [], 0
        for size in sorted(self.waiting, reverse=True):
            for s in self.waiting[size]:
                out.append((self.number + total // self.tokens, size, s))
                total += size
        return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, cell_tokens: int = CELL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: the id column, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, sequence_tokens, offset, step_group.

    ``tiers``: window sizes, rising powers of two; ``step_tokens`` a multiple of the largest.
    """
    kind = df.schema[id_col].dataType
    numbers = ("start", "doc_tokens", "sequence_id", "sequence_tokens", "offset", "step_group")
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in numbers)])
    longest = tiers[-1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, base = vocabulary(path), TaskContext.get().partitionId() << COUNTED_BITS
        pool, steps = Pool(), Steps(step_tokens)
        names: dict[int, tuple] = {}  # of documents: id, tokens, ids not yet given out
        n_docs = n_sequences = 0
        last_type = None

        def out(given: list[tuple[int, int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences
            ids, raw, rows = [], [], []
            for group, size, pieces in given:
                at = 0
                for doc, start, part in pieces:
                    name, tokens, left = names[doc]
                    names[doc] = (name, tokens, left - len(part))
                    if left == len(part):
                        del names[doc]
                    ids.append(name)
                    raw.append(part.tobytes())
                    rows.append((start, tokens, base | n_sequences, size, at, base | group))
                    at += len(part)
                n_sequences += 1
            if rows:
                columns = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(ids, last_type), pa.array(raw, pa.binary()), *(pa.array(c) for c in columns)], names=[id_col, "ids", *numbers])

        for batch in batches:
            last_type = batch.schema.field(0).type
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, PIECE_BYTES):
                part = batch.slice(a, b - a)
                for name, raw in zip(part.column(0).to_pylist(), vocab.encode_runs(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                    doc, n_docs = n_docs, n_docs + 1
                    names[doc] = (name, len(ids), len(ids))
                    given = []
                    whole = len(ids) - len(ids) % longest
                    for k in range(0, whole, longest):
                        given += steps.add(longest, [(doc, k, ids[k : k + longest])])
                    pool.put((doc, whole, ids[whole:].copy() if whole else ids))
                    if pool.tokens >= cell_tokens:
                        for size, pieces in packed(pool, tiers):
                            given += steps.add(size, pieces)
                    yield from out(given)
        given = []
        for make in (packed(pool, tiers), leftovers(pool, longest)):
            for size, pieces in make:
                given += steps.add(size, pieces)
        yield from out(given + steps.rest())

    return df.select(id_col, text_col).mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op12: every piece of every document, where it lies, and the digest of its ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or default_path())
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"
    )
