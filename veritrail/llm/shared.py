"""Helpers that every operator of this subpackage uses: scratch tables in the shared folder,
row keys, and numpy views of text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on, which bounds a Python worker's memory.
CHUNK_BYTES = 1 << 19
#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES``. Else they have 10,000 texts, tens of MiB each, which an executor
    holds several times at once: as vectors, in the buffer that is sent, and in the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which all executors and the driver share.

    Only where that setting is unset in a local session (tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    base = base or _OWN.setdefault("dir", "") or _own_dir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/veritrail/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


_OWN: dict[str, str] = {}


def _own_dir() -> str:
    _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="veritrail-")
    return _OWN["dir"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    That cuts the lineage, survives lost executors, and lets Spark drop the shuffles behind it:
    the cleaner runs when the driver's JVM collects garbage, so that is asked for here.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    spark._jvm.System.gc()
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``table``. Only when all that was made from it is stored in turn:
    nothing may read it again, nor a lost executor make another task do so."""
    spark, path = table.sparkSession, _PATHS.pop(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


_SETTLED: list[bool] = []


def released() -> None:
    """Give what a Python worker has freed back to the system: workers live on from task to task and from stage to stage.

    What lives at a worker's first call, mostly modules, is not looked through again by later ones."""
    gc.collect()
    if not _SETTLED:
        gc.freeze()
        _SETTLED.append(True)
    pa.default_memory_pool().release_unused()
    if _TRIM:  # glibc keeps freed pages below the first one in use
        _TRIM(0)


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row by its id and text; rows equal in both share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def column_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = pa.large_binary()
    arr = arr.cast(pa.large_string()).cast(kind) if pa.types.is_string(arr.type) else arr.cast(kind)
    arr = pc.fill_null(arr, b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to ``limit`` at most, or one longer row alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


#: Hashes whose frequency is known to the workers, at most; and their least count among so many.
FREQUENT, LEAST_COUNT, COUNTED_AT_ONCE = 500_000, 3, 3_000_000


def frequent(texts: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent hashes of ``texts`` (sorted) and their counts: ``FREQUENT`` at most, by which others are outranked.

    ``hashes`` gives those of some texts' bytes and offsets. Each task counts some millions at a time and
    passes on those that occur ``LEAST_COUNT`` times there; Spark adds them up. A cut-off count is chosen
    from the histogram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c >= LEAST_COUNT], c[c >= LEAST_COUNT]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], names=["t", "c"])

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in chunks(np.diff(offsets)):
                held.append(hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if sum(map(len, held)) > COUNTED_AT_ONCE:
                    yield flush()
        if held:
            yield flush()
        released()

    counted = stored(texts.select("text").mapInArrow(count, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")), name)
    level = F.floor(F.log2("c") * 8).cast("int").alias("level")
    cut, total = None, 0
    for r in sorted(counted.groupBy(level).count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > FREQUENT:
            break
        cut = r.level
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counted.where(F.floor(F.log2("c") * 8) >= cut).toArrow()
    t, c = got.column("t").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse_powers(n: int) -> np.ndarray:
    """base**0 .. base**-(n-1) modulo 2**64."""
    out = np.full(max(n, 1), pow(_BASE, -1, 2**64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: 64-bit hash of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray, lower: bool = True):
        """``is_break[byte]``: the byte separates words; A-Z are lower-cased if asked for."""
        if lower:
            data = _LOWER[data]
        n_texts = len(offsets) - 1
        inside = ~is_break[data]
        begins = inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            firsts = offsets[:-1][(offsets[:-1] < offsets[1:])]
            begins[firsts] = inside[firsts]  # a text's first byte begins a word anew
        self.begin = np.flatnonzero(begins)
        if len(self.begin):
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[lasts] = inside[lasts]
            self.end = np.flatnonzero(ends) + 1
            up, self._down = _running(len(data))
            self._sum = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sum[1:])
            self.hash = mix(self._of(self.end) + (self.end - self.begin).astype(np.uint64))
        else:
            self.end = self.begin
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.begin, offsets)  # of each text, and the total
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(n_texts), self.count)

    def _of(self, end: np.ndarray) -> np.ndarray:
        """Sum of each word's bytes up to ``end``, as if the word came first."""
        return (self._sum[end] - self._sum[self.begin]) * self._down[self.begin]

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes, other than any word's own."""
        if not len(self.begin):
            return self.hash
        return mix(self._of(np.minimum(self.end, self.begin + n)) ^ np.uint64(0x5555555555555555))


_POWERS: dict[str, np.ndarray] = {}


def _running(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for ``n`` places; those of a chunk are kept for the next one."""
    if n > CHUNK_BYTES * 2:
        return powers(n), inverse_powers(n)
    if not _POWERS:
        _POWERS.update(up=powers(CHUNK_BYTES * 2), down=inverse_powers(CHUNK_BYTES * 2))
    return _POWERS["up"], _POWERS["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def breaks(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Space and \t..\r, as in ``[^\x20\x09-\x0D]+``.
SPACES = breaks([0x20, *range(0x09, 0x0E)])
#: ASCII but digits and letters, as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text.
MARKS = breaks([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


#: Of a packed value, the bits that tell tags apart (two have the same once in 2**28); the others are the value's first.
TAG_BITS, BLOOM_BITS = 28, 1 << 29


def _positions(key: np.ndarray, n_bits: int) -> list[np.ndarray]:
    return [mix(key + np.uint64(i)) & np.uint64(n_bits - 1) for i in (1, 2)]


def longs(lists: pa.Array) -> pa.ListArray:
    """Lists of longs, which may be given as binary values: those pass through Spark in one piece, not number by number."""
    if pa.types.is_list(lists.type):
        return lists
    offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)
    raw = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 8, pa.int32()), pa.array(raw.view(np.int64)))


def binary(lists: pa.ListArray) -> pa.Array:
    """Lists of longs (none null) as binary values."""
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(np.ascontiguousarray(lists.flatten().to_numpy()))])


#: Values that a task of ``values_of_many`` sorts at once; ranges of values for a shuffle partition.
SORTED_AT_ONCE, RANGES = 1_000_000, 4


def _spread(form: np.ndarray) -> np.ndarray:
    """Another number for each, whose first bits are dealt evenly: values may be the least of many."""
    return form * np.uint64(_BASE)


def values_of_many(rows: DataFrame, lists: str, tag: str, name: str, forms: Callable[[pa.RecordBatch], list[np.ndarray]] | None = None) -> Broadcast:
    """Bloom filter of the values in ``lists`` (array<long>, or binary) that rows of more than one ``tag`` (long) hold.

    Value and tag are packed in one number, 36 bits and ``TAG_BITS``, of which a task passes on the least
    and the greatest for each value of some rows, so a value that very many rows hold is no hot spot. They are
    shuffled by range of values, those of a range in one row for each million or so, and met range by range. The
    filter has 16 bits a value with two set, ``BLOOM_BITS`` (64 MiB) at most: it may let other values
    through, and loses none but those whose tags agree in all ``TAG_BITS``. ``forms`` gives what stands in
    the filter for a batch's values, once or several times each.
    """
    low = np.uint64(TAG_BITS)
    range_bits = (RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            packed = np.sort(np.concatenate(held))
            held.clear()
            edge = np.ones(len(packed), bool)
            if len(packed) > 2:
                key = packed >> low
                edge[1:-1] = (key[1:-1] != key[:-2]) | (key[1:-1] != key[2:])
            packed = packed[edge]
            of = (packed >> np.uint64(64 - range_bits)).astype(np.int32)
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            ends = np.concatenate((begin, [len(of)])).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(of[begin]), values], names=["part", "packs"])

        for batch in batches:
            values = longs(batch.column(lists))
            own = np.repeat(batch.column(tag).to_numpy().view(np.uint64) >> np.uint64(64 - TAG_BITS), values.value_lengths().to_numpy())
            of_batch = forms(batch) if forms else [values.flatten().to_numpy().view(np.uint64)]
            held += [_spread(form) >> low << low | own for form in of_batch]
            if sum(map(len, held)) > SORTED_AT_ONCE:
                yield flush()
        if held:
            yield flush()
        released()

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of packs, range by range, the keys of several tags."""

        def met() -> pa.RecordBatch:
            packed = np.sort(np.concatenate(held))
            held.clear()
            key = packed >> low
            found = key[1:][(key[1:] == key[:-1]) & (packed[1:] != packed[:-1])]
            found = found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            for part, packs in zip(batch.column("part").to_pylist(), batch.column("packs")):
                if held and part != last:
                    yield met()
                held.append(np.frombuffer(packs.as_py(), np.uint64))
                last = part
        if held:
            yield met()
        released()

    packed = (rows if forms else rows.select(lists, tag)).mapInArrow(pack, "part int, packs binary").repartition("part").sortWithinPartitions("part")
    keys = stored(packed.mapInArrow(many, "key long"), name)
    n_bits = min(BLOOM_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_positions(batch.column("key").to_numpy().view(np.uint64), n_bits))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    words = keys.mapInArrow(places, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(n_bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def let_through(bits: np.ndarray, forms: list[np.ndarray]) -> np.ndarray:
    """Of some values, each given in one form or several, those of which the filter lets a form through."""
    kept = np.zeros(len(forms[0]), bool)
    for form in forms:
        through = np.ones(len(form), bool)
        for place in _positions(_spread(form) >> np.uint64(TAG_BITS), len(bits) << 6):
            through &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        kept |= through
    return kept


def only_held(rows: DataFrame, lists: str, bits: Broadcast) -> DataFrame:
    """``rows`` with the values of ``lists`` (array<long>, or binary) that the filter lets through."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, at = batch.column(lists), batch.schema.get_field_index(lists)
            values = longs(given)
            few = kept_of(values, let_through(bits.value, [values.flatten().to_numpy().view(np.uint64)]))
            few = few if values is given else binary(few)
            yield pa.RecordBatch.from_arrays([few if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
        released()

    return rows.mapInArrow(held, rows.schema)


def kept_of(values: pa.ListArray, kept: np.ndarray) -> pa.ListArray:
    """The lists with those of their values that are marked."""
    ends = np.concatenate(([0], np.cumsum(values.value_lengths().fill_null(0).to_numpy())))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept)))[ends].astype(np.int32)), pa.array(values.flatten().to_numpy()[kept]))
