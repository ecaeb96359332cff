"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that occurs elsewhere too.

Suffix order over a whole corpus is cut into independent pieces by content. In every window of
``LENGTH`` bytes the least hash of its ``GRAM``-byte strings names an anchor; equal windows have equal
anchors at the same place, so only windows of the same anchor are ever compared. The windows that
share one anchor occurrence form a context (a few hundred bytes).

1. One pass over the texts emits each context: hash of the anchor, hash of the context, document, place.
   Anchors that occur once are dropped.
2. Equal contexts are counted by Spark; every window of a context that occurs twice is repeated, and
   one copy of it goes on.
3. The different contexts of an anchor are put together by the thousand, and their suffixes sorted to
   a depth of ``LENGTH`` bytes (prefix doubling). Longest previous factors come from the previous and
   next smaller positions in that order: a window has an earlier (later) copy if the previous (next)
   position of its factor agrees over the full depth. An anchor with very many contexts is split by a
   hash of the windows, so that equal windows still meet and no group grows with the corpus.
4. Repeated windows become byte spans of their documents, and spans are cut out.

``keep="first"`` leaves the first copy by (doc_id, place); ``keep="none"`` removes all copies.

Defined results: null and empty texts have no bytes; texts below ``LENGTH`` bytes keep them all; rows
equal in id and text are two documents that repeat each other (with keep="first" both stay, as neither
comes first); a null doc_id counts as the largest. Hashes have 64 bits; contexts equal in hash are
taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, column_bytes, mix, powers, row_key, stored

LENGTH = 200
GRAM = 40
#: Window starts worked on at once in a long text; positions take 24 bits of the sort key.
BLOCK = 1 << 20
GROUP_CONTEXTS = 4096
_LAST = 2**63 - 1


def _inverse(n: int) -> np.ndarray:
    out = np.full(max(n, 1), pow(int(powers(2)[1]), -1, 2**64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any byte range, by running sums."""

    def __init__(self, data: np.ndarray):
        self.inv = _inverse(len(data) + 1)
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.run[end] - self.run[start]) * self.inv[start])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text, anchor hash, context hash, first window, number of windows: for each run of windows with one anchor."""
    width = length - gram + 1
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    roll = Rolling(data)
    at = np.arange(n - gram + 1)
    full = mix((roll.run[gram:] - roll.run[: n - gram + 1]) * roll.inv[: n - gram + 1])
    key = (full & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    size, least = 1, key
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    extra = width - size
    least = np.minimum(least[: len(least) - extra], least[extra:]) if extra else least
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # of the window at each place
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + length <= offsets[text + 1]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    hi = np.flatnonzero(stop)
    a = anchor[lo]
    ctx = mix(roll.of(lo, hi + length) + mix((hi - lo).astype(np.uint64)) + mix(mix((a - lo).astype(np.uint64) + np.uint64(7))))
    return text[lo], full[a], ctx, lo - offsets[text[lo]], hi - lo + 1


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        did, dk = batch.column("did").to_numpy(), batch.column("__key").to_numpy()
        for a, b in chunks(np.diff(offsets), BLOCK):
            span = int(offsets[b] - offsets[a])
            # one long text is cut into blocks that overlap by a window
            for s in range(0, max(1, span - LENGTH + 1), BLOCK) if span > BLOCK else (0,):
                e = min(span, s + BLOCK + LENGTH - 1) if span > BLOCK else span
                own = np.array([0, e - s]) if span > BLOCK else offsets[a : b + 1] - offsets[a]
                text, anchor, ctx, lo, n = contexts(data[offsets[a] + s : offsets[a] + e], own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(did[a + text]), pa.array(dk[a + text]), pa.array(lo + s), pa.array(n.astype(np.int32))],
                    names=["anchor", "ctx", "did", "__key", "lo", "n"],
                )


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes cut off at ``depth`` (ties by position), and the rank of each.

    Prefix doubling over the whole text, from ranks of 8 bytes on; ranks are equal if and only if the
    first ``depth`` bytes are.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    size = 8
    _, rank = np.unique(rank, return_inverse=True)
    while size < depth:
        step = min(size, depth - size)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        pair = rank * np.int64(n + 1) + later
        size += step
        if size >= depth:
            pair = pair[starts]
        _, rank = np.unique(pair, return_inverse=True)
    order = np.lexsort((starts, rank))
    return starts[order], rank[order]


def smaller_positions(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the last place before and the first after it with a smaller
    position (-1 if there is none), in one pass with a stack."""
    before, after, stack = np.full(len(order), -1), np.full(len(order), -1), []
    for i, p in enumerate(order.tolist()):
        while stack and stack[-1][1] > p:
            after[stack.pop()[0]] = i
        if stack:
            before[i] = stack[-1][0]
        stack.append((i, p))
    return before, after


def repeated(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ``depth`` bytes at each of ``starts`` occur at an earlier, and at a later one of them.

    Longest previous factors: the earlier position with the longest common prefix is the previous or
    the next smaller position in suffix order; it agrees over ``depth`` bytes if the ranks are equal.
    """
    order, rank = suffix_order(data, starts, depth)
    same = np.zeros(len(order), bool)  # of the same rank as the next
    same[:-1] = rank[:-1] == rank[1:]
    some = same.copy()
    some[1:] |= same[:-1]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    place = np.flatnonzero(some)
    if len(place):
        r = rank[place]
        for found, position in ((earlier, order[place]), (later, -order[place])):
            for other in smaller_positions(position):
                hit = np.flatnonzero(other >= 0)
                hit = hit[r[other[hit]] == r[hit]]
                found[place[hit]] = True
    back = np.argsort(order, kind="stable")
    at = back[np.argsort(np.argsort(starts, kind="stable"), kind="stable")]
    return earlier[at], later[at]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_PIECE = "g long, parts int, part int, did long, __key long, lo long, n int, copies long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each text; contexts of an anchor in several parts go to those that hold a window of theirs."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        dk = batch.column("__key").to_pylist()
        rows = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            for w in wanted:
                piece = text[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH]
                parts = [0] if w["parts"] == 1 else np.unique(_part_of(piece, w["n"], w["parts"])).tolist()
                raw = piece.tobytes()
                for p in parts:
                    g = w["g"] if w["parts"] == 1 else (w["g"] * 1_000_003 + p) % 2**62
                    rows.append((g, w["parts"], p, w["did"], dk[i], w["lo"], w["n"], w["copies"], raw))
            if len(rows) > 5000:
                yield _piece_batch(rows)
                rows = []
        if rows:
            yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _PIECE.split(", ")])


def _part_of(piece: np.ndarray, n: int, parts: int) -> np.ndarray:
    at = np.arange(n)
    return (Rolling(piece).of(at, at + LENGTH) % np.uint64(parts)).astype(np.int64)


def _factor_spans(table: pa.Table) -> pa.Table:
    """Spans of the repeated windows of one group of contexts: key, begin, end, and whether an earlier copy exists."""
    table = table.sort_by([("did", "ascending"), ("__key", "ascending"), ("lo", "ascending")]).combine_chunks()
    data, offsets = column_bytes(table.column("bytes"))
    n = table.column("n").to_numpy()
    parts, part = table.column("parts").to_numpy(), table.column("part").to_numpy()
    starts = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if len(parts) and parts[0] > 1:
        keep = np.concatenate([_part_of(data[offsets[i] : offsets[i + 1]], n[i], parts[i]) == part[i] for i in range(len(n))])
    else:
        keep = np.ones(len(starts), bool)
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[keep], later[keep] = repeated(data, starts[keep], LENGTH)
    first, dk, lo, copies = np.cumsum(n) - n, table.column("__key").to_numpy(), table.column("lo").to_numpy(), table.column("copies").to_numpy()
    rows: list[tuple] = []
    any_in = np.add.reduceat(earlier | later, first) if len(first) else first
    for i in np.flatnonzero(any_in).tolist():
        for early, flags in ((True, earlier), (False, earlier | later)):
            if early or copies[i] == 1:
                rows += [(dk[i], lo[i] + b, lo[i] + e - 1 + LENGTH, early) for b, e in _runs(flags[first[i] : first[i] + n[i]])]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], names=["__key", "begin", "end", "early"])


def spans(docs: DataFrame, keep: str = "none") -> DataFrame:
    """__key (``row_key`` of a document) and spans (array of begin, end): what is to be removed, stored."""
    texts = docs.select(row_key("doc_id", "text").alias("__key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), "text").where(F.octet_length("text") >= LENGTH)
    every = stored(texts.mapInArrow(_context_rows, "anchor long, ctx long, did long, __key long, lo long, n int"), "contexts")
    twice = every.groupBy("anchor").agg(F.count("*").alias("c"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    twice = stored(twice, "repeated-anchors")  # so that both sides of the next join are shuffled for it and a hot anchor is split
    shared = stored(every.join(twice, "anchor"), "shared-contexts")
    counted = stored(
        shared.groupBy("anchor", "ctx", "mixed").agg(F.count("*").alias("copies"), F.min(F.struct("did", "__key", "lo", "n")).alias("first")), "counted-contexts"
    )
    mixed = counted.where("mixed")
    total = mixed.count()
    per_anchor = stored(mixed.groupBy("anchor").agg(F.ceil(F.count("*") / GROUP_CONTEXTS).cast("int").alias("parts")), "anchor-parts")
    groups = max(1, total // (GROUP_CONTEXTS // 2))
    g = F.when(F.col("parts") == 1, F.pmod("anchor", F.lit(groups))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(2**40)) + 2**41)
    wanted = mixed.join(per_anchor, "anchor").select(g.alias("g"), "parts", "copies", "first.*").groupBy("__key").agg(F.collect_list(F.struct("g", "parts", "did", "lo", "n", "copies")).alias("wanted"))
    pieces = texts.select("__key", "text").join(wanted, "__key").dropDuplicates(["__key"]).mapInArrow(_pieces, _PIECE)
    partial = pieces.groupBy("g").applyInArrow(_factor_spans, "__key long, begin long, end long, early boolean")
    whole = shared.join(counted.where("copies > 1").select("anchor", "ctx", "first"), ["anchor", "ctx"])
    if keep == "first":
        partial = partial.where("early")
        whole = whole.where(F.struct("did", "__key", "lo") != F.struct("first.did", "first.__key", "first.lo"))
    else:
        # a context that occurs once is judged by its windows; of the others all windows are repeated
        partial = partial.where("NOT early")
    found = whole.select("__key", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("end")).unionByName(partial.select("__key", "begin", "end"))
    return stored(found.groupBy("__key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "repeated-spans")


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary: the bytes that stay)."""

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def apply(text: pa.Array, where: pa.Array) -> pa.Array:
        data, offsets = column_bytes(text)
        removed, count, kept = [], [], []
        for i, pairs in enumerate(where.to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            if pairs:
                level = np.zeros(len(raw) + 1, np.int32)
                np.add.at(level, [p["begin"] for p in pairs], 1)
                np.add.at(level, [p["end"] for p in pairs], -1)
                gone = np.cumsum(level[:-1]) > 0
                removed.append(int(gone.sum()))
                count.append(len(_runs(gone)))
                kept.append(raw[~gone].tobytes())
            else:
                removed.append(0)
                count.append(0)
                kept.append(raw.tobytes())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["n_removed", "n_spans", "kept"])

    out = docs.drop("n_bytes", "n_removed", "n_spans", "kept").withColumn("__key", row_key("doc_id", "text")).join(found.withColumnRenamed("spans", "__spans"), "__key", "left")
    out = out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("__cut", apply("text", "__spans"))
    return out.select("*", "__cut.*").drop("__cut", "__key", "__spans")


def dedup(docs: DataFrame, keep: str = "first") -> DataFrame:
    """``docs`` with the columns of ``cut``; ``keep``: first or none of the copies."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep: {keep!r}")
    return cut(docs, spans(docs, keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: bytes and spans removed from every document when all copies go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, "none").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
