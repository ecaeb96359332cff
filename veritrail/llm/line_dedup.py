"""Line dedup by a deletion-neighbourhood join.

Lines are split at newlines and compared as sequences of words (runs of other than ASCII space), so
white space does not count. A line goes if an earlier line, by (doc_id, line number), is the same or
near; whether the earlier line itself stays does not matter. Blank lines always stay. Near means, with
the shorter line's length as the measure:

* lines of ``MIN_WORDS`` words and more: at most a tenth of its words, at least one, put in, left out or
  replaced;
* lines of fewer words: the same number of words, all but one of them equal, and in that one at most
  as many characters put in, left out or replaced as a tenth of the line's characters (spaces not
  counted, rounded down: none in a line of under ten).

One edit (lines of up to ``WIDE`` words): two lines at most one edit apart share a variant, a line with at most one word left out. Each line
emits its variants as hashed keys with the place of the missing word: equal (variant, place) means one
word replaced, a variant equal to a whole line means one word put in. Per key only the earliest line
is kept, so nothing is paired within a key. The line a removal rests on is then fetched, and the edit
distance verified on the words. Long lines have many variants; but an edit leaves the first or the
second half of the words as it was, so only lines that share such a half (and a fitting length) with
another line emit any.

More edits (lines of ``WIDE`` words and more; all variants within the bound would be too many, two
million for 50 words): of each line only the variants are kept that leave one pair of consecutive words,
and of those only the rarest. k edits touch 2 k pairs at most, so of the pairs in a common order two near
lines share one of their first 2 k + 1 (a pair that occurs again counts as another, but has no key: who shares
it shares the first, which comes before it), and only pairs that two lines of like length have are met at. The order is by how
often the words occur, as far as the workers know it, and only decides speed. Lines that share a pair must
also agree in length and in a 128-bit parity of their words' hashes (an edit turns two bits at most); the
edit distance is then verified on the words. Short lines share a variant at the same place and single
words a window of bytes. In both, a line is compared with the earliest of each key first, and only lines
not yet found near with all of them, so large groups of near copies are not paired.

Hashes of prefixes and variants come from running sums of word hashes times powers of an odd base, so
a variant costs a few operations, not a pass over the line.

Defined results: null and empty texts have one blank line; a null doc_id counts as the largest; rows
equal in id and text are one document; two lines at the same (doc_id, line number) do not remove each
other; columns other than text and n_chars pass through.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CHUNK_BYTES, SPACES, Words, binary, chunks, column_bytes, discard, inverse_powers, kept_of, let_through, longs, mix, only_held, powers, released, row_key, small_batches, stored, values_of_many

MIN_WORDS = 8
#: Lines of so many words and more may have two edits; a tenth of the words (of a short line's characters).
WIDE, SHARE = 20, 10
#: Bytes of a key of single words; bits of the table of frequencies (4 MiB).
RUN_BYTES, LEVEL_BITS = 4, 22
#: Bits of a pair of words, which sort in one number with a chunk's line and a frequency.
PAIR_BITS = 41
#: Lines of so many words and more have a parity of 512 bits, others of 128.
LONG = 40
#: Orders by which a line's least keys are taken.
LEAST = 3
#: Tables of at most so many rows (of 8 bytes), or so many line numbers, are broadcast; larger ones are shuffled.
BROADCAST_HALVES, BROADCAST_LINES = 1_000_000, 3_000_000
#: Ratio of the lengths in one step; near lines are in one step or in two that follow each other.
STEP = 1.11
PARITY = [f"p{i}" for i in range(8)]
_LAST = 2**63 - 1


def least_run(longest: int, run: int) -> np.ndarray:
    """By length: how long a run of consecutive ``run``-windows any near line of that length has intact.

    The pair's shorter length may be this line's or less by the edits that it allows.
    """
    s = np.arange(longest + 1)
    k = np.maximum(1, s // SHARE)
    own = np.maximum(-(-(s - k) // (k + 1)) - run + 1, 1)
    out = own.copy()
    for less in range(1, int(k[-1]) + 1):
        fits = k[:-less] >= less
        out[less:][fits] = np.minimum(out[less:], own[:-less])[fits]
    return np.minimum(out, 8)


def sampled(values: np.ndarray, begin: np.ndarray, count: np.ndarray, length: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, place, key): of ``count`` values from ``begin``, the windows of ``run`` that are least in ``least_run`` of them."""
    windows = np.maximum(count - run + 1, 0)
    which = np.repeat(np.arange(len(begin)), windows)
    place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[which] + place
    key = np.zeros(len(which), np.uint64)
    for j, factor in enumerate(powers(run + 1)[1:]):
        key += values[at + j] * factor
    key = mix(key + np.uint64(run))
    need = least_run(int(length.max(initial=1)), run)[length][which]
    reach = np.ones(len(which), np.int64)
    for step in (-1, 1):
        going = np.ones(len(which), bool)
        for d in range(1, int(need.max(initial=1))):
            ok = np.zeros(len(which), bool)
            if d < len(which):
                a, b = (slice(d, None), slice(None, -d)) if step < 0 else (slice(None, -d), slice(d, None))
                ok[a] = (which[a] == which[b]) & (key[b] >= key[a])
            going &= ok
            reach += going
    kept = np.flatnonzero(reach >= need)
    return which[kept], place[kept], key[kept]


class Lines:
    """Lines of some texts with running sums of their word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        newline = np.flatnonzero(data == 10)
        self.per_text = np.diff(np.searchsorted(newline, offsets)) + 1
        last = np.cumsum(self.per_text) - 1
        self.text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        self.number = np.arange(len(self.text)) - (last - self.per_text + 1)[self.text]
        self.begin = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
        self.end = np.empty_like(self.begin)
        self.end[:-1] = self.begin[1:] - 1
        self.end[last] = offsets[1:]
        words = Words(data, np.concatenate((self.begin, offsets[-1:])), SPACES, lower=False)
        self.data = data
        self.words, self.n, self.first = words, words.count, words.first[:-1]
        place = np.arange(len(words.hash)) - self.first[words.text]
        longest = int(self.n.max(initial=0)) + 2
        self.pow, self.inv = powers(longest), inverse_powers(longest)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hash * self.pow[place], dtype=np.uint64)))
        self.run = run

    def prefix(self, line: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sum over the first h words."""
        return self.run[self.first[line] + h] - self.run[self.first[line]]

    def suffix(self, line: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sum over the last h words, as if they came first."""
        end = self.first[line] + self.n[line]
        return (self.run[end] - self.run[end - h]) * self.inv[self.n[line] - h]

    def whole(self) -> np.ndarray:
        every = np.arange(len(self.n))
        return mix(self.prefix(every, self.n) + mix(self.n.astype(np.uint64)))

    def parity(self) -> list[np.ndarray]:
        """Which hash values occur an odd number of times, as eight columns: two of 128 bits, and for lines of
        ``LONG`` words and more the last six of 512 bits (the first two follow from the others), else 0."""
        value = self.words.hash >> np.uint64(55)
        one = np.uint64(1) << (value & np.uint64(63))
        word = (value >> np.uint64(6)).astype(np.int64)
        some, long = self.n > 0, self.n >= LONG
        wide = np.zeros((8, len(self.n)), np.uint64)
        if some.any():
            for i in range(8):
                wide[i, some] = np.bitwise_xor.reduceat(np.where(word == i, one, np.uint64(0)), self.first[some])
        narrow = [np.bitwise_xor.reduce(wide[i::2], axis=0) for i in (0, 1)]
        return [*narrow, *[np.where(long, w, np.uint64(0)) for w in wide[2:]]]

    def rare_pairs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, key), by line: the pairs of words by which lines of ``WIDE`` words and more meet."""
        level = known[self.words.hash >> np.uint64(64 - LEVEL_BITS)]
        of = self.words.text
        begin = np.flatnonzero((of[1:] == of[:-1]) & (self.n[of[1:]] >= WIDE))
        line, h = of[begin], self.words.hash
        key = mix(h[begin] * self.pow[1] + h[begin + 1] * self.pow[2] + np.uint64(1)) >> np.uint64(64 - PAIR_BITS)
        rank = level[begin].astype(np.uint64) + level[begin + 1]  # 9 bits
        begins = np.concatenate(([True], line[1:] != line[:-1])) if len(line) else np.zeros(0, bool)
        number, known_lines = np.cumsum(begins) - 1, line[begins]
        if len(known_lines) >> (64 - 9 - PAIR_BITS):  # of a text longer than a chunk
            order = np.lexsort((key, rank, line))
            line, key = line[order], key[order]
        else:
            packed = np.sort(number.astype(np.uint64) << np.uint64(9 + PAIR_BITS) | rank << np.uint64(PAIR_BITS) | key)
            key = packed & np.uint64((1 << PAIR_BITS) - 1)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        place = np.arange(len(key)) - np.flatnonzero(begins)[number]
        kept = first & (place <= 2 * (self.n[line] // SHARE))
        return line[kept], mix(key[kept])

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, word, characters) of lines of 1 to ``MIN_WORDS`` - 1 words and ten characters or more.

        ``word`` is the number of the word that may differ.
        """
        lead = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        size = lead[self.words.end] - lead[self.words.begin]
        upto = np.concatenate(([0], np.cumsum(size)))
        chars = upto[self.first + self.n] - upto[self.first]
        line = np.flatnonzero((self.n > 1) & (self.n < MIN_WORDS) & (chars >= SHARE))
        which, key, place = self.variants(line)
        inside = place >= 0
        line, place = line[which[inside]], place[inside]
        key = mix(key[inside] + mix((place + 1).astype(np.uint64)))
        alone = np.flatnonzero((self.n == 1) & (chars >= SHARE))
        word = self.first[alone]
        value = mix(self.data.astype(np.uint64) + np.uint64(1))
        begin = self.words.begin[word]
        of, _, part = sampled(value, begin, self.words.end[word] - begin, chars[alone], RUN_BYTES)
        return np.concatenate((line, alone[of])), np.concatenate((key, part)), np.concatenate((self.first[line] + place, word[of])), np.concatenate((chars[line], chars[alone][of]))

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of the halves by which lines at most one edit apart meet.

        With s the shorter length of a pair: the first s // 2 words or the last s - s // 2 are the same.
        """
        line = np.flatnonzero((self.n >= MIN_WORDS) & (self.n <= WIDE))
        out_line, out_key = [], []
        for shorter in (0, 1):  # the pair's shorter length, from this line's
            s = self.n[line] - shorter
            tag = mix(s.astype(np.uint64))
            for side, key in ((1, self.prefix(line, s // 2)), (2, self.suffix(line, s - s // 2))):
                out_line.append(line)
                out_key.append(mix(key + tag + np.uint64(side)))
        return np.concatenate(out_line), np.concatenate(out_key)

    def variants(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``line``, variant, place) with each word left out, and the whole line at place -1."""
        n = self.n[line]
        which = np.repeat(np.arange(len(line)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        of = line[which]
        left = self.prefix(of, place)
        right = (self.run[self.first[of] + self.n[of]] - self.run[self.first[of] + place + 1]) * self.inv[1]
        part = mix(left + right + mix((n[which] - 1).astype(np.uint64)))
        return np.concatenate((which, np.arange(len(line)))), np.concatenate((part, self.whole()[line])), np.concatenate((place, np.full(len(line), -1)))


#: Parts of the table of frequencies that are summed apart; and the least count that a task passes on.
LEVEL_PARTS, LEAST_COUNT = 64, 3


def word_levels(source: DataFrame) -> np.ndarray:
    """Table of frequency by a word hash's first ``LEVEL_BITS``: of the words there, a fourth of an octave each; 0 if few or none.

    Each task counts in a table of that size and passes on its parts, of which Spark's tasks make the sums.
    """
    size = (1 << LEVEL_BITS) // LEVEL_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << LEVEL_BITS, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in chunks(np.diff(offsets), CHUNK_BYTES // 2):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACES, lower=False)
                np.add.at(table, (words.hash >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), 1)
        for part in range(LEVEL_PARTS):
            own = table[part * size : (part + 1) * size]
            at = np.flatnonzero(own >= LEAST_COUNT)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.stack((at, own[at])).tobytes()], pa.binary())], names=["part", "counts"])
        released()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the tables of one part after another, the levels of the part."""
        last, total = None, np.zeros(size, np.int64)

        def of_part() -> pa.RecordBatch:
            level = np.where(total > 0, np.minimum(1 + 4 * np.log2(np.maximum(total, 1)), 255), 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "levels"])

        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                if last is not None and part != last:
                    yield of_part()
                    total[:] = 0
                last = part
                at, own = np.frombuffer(counts.as_py(), np.int64).reshape(2, -1)
                total[at] += own
        if last is not None:
            yield of_part()
        released()

    counted = source.select("text").mapInArrow(count, "part int, counts binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((LEVEL_PARTS, size), np.uint8)
    for r in counted.mapInArrow(sums, "part int, levels binary").collect():
        out[r.part] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


def _per_chunk(names: list[str], kinds: list[pa.DataType], rows):
    """mapInArrow function: ``rows(batch part, Lines)`` gives the columns of the result."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in chunks(np.diff(offsets)):
                part = batch.slice(a, b - a)
                lines = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = rows(part, lines)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names=names)
        released()

    return task


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(row_key("doc_id", "text").alias("__key"), F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("did"), "text")


def _lists(of: np.ndarray, values: np.ndarray, wanted: np.ndarray, n: int) -> pa.ListArray:
    """The values of each line in ``wanted``; ``of``: their lines, in order."""
    count = np.bincount(of, minlength=n)[wanted]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(_signed(values)))


def _rows_of(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """Of a matrix of longs the marked rows as binary values, null for the others."""
    out = binary(pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * values.shape[1], pa.int32()), pa.array(_signed(values[some].ravel()))))
    return out.take(pa.array(np.cumsum(some) - 1, mask=~some))


def line_table(docs: DataFrame) -> DataFrame:
    """Every line that is not blank, stored: __key, did, line, h, n, halves, said (a short line's text), pairs, parity (where there are pairs).

    Of equal lines that are read together only the earliest has pairs, so a very frequent line has few rows of them.
    """
    source = _source(docs)
    known = docs.sparkSession.sparkContext.broadcast(word_levels(source))

    def rows(part, lines):
        kept = np.flatnonzero(lines.n > 0)
        of, key = lines.halves()
        order = np.argsort(of, kind="stable")
        h, text, n = lines.whole(), lines.text, len(lines.n)
        did = part.column("did").to_numpy()
        own = part.column("__key").to_numpy()
        by = np.lexsort((own[text], lines.number, did[text], h))  # the order in which ``wide_lines`` takes the earliest
        first = np.zeros(n, bool)
        first[by] = np.concatenate(([True], h[by][1:] != h[by][:-1])) if n else []
        line, pair = lines.rare_pairs(known.value)
        mine = first[line]
        some = (first & (lines.n >= WIDE))[kept]
        parity = _rows_of(np.stack([c[kept] for c in lines.parity()], 1), some)
        raw = lines.data.tobytes()
        said = [raw[x:y].decode() if c < MIN_WORDS else None for x, y, c in zip(lines.begin[kept].tolist(), lines.end[kept].tolist(), lines.n[kept].tolist())]
        return (
            own[text[kept]], did[text[kept]], lines.number[kept], _signed(h[kept]), lines.n[kept], _lists(of, key[order], kept, n), said,
            binary(_lists(line[mine], pair[mine], kept, n)), parity,
        )

    long, int_ = pa.int64(), pa.int32()
    names = ["__key", "did", "line", "h", "n", "halves", "said", "pairs", "parity"]
    kinds = [long, long, int_, long, int_, pa.list_(long), pa.string(), pa.binary(), pa.binary()]
    ddl = "__key long, did long, line int, h long, n int, halves array<long>, said string, pairs binary, parity binary"
    return stored(source.mapInArrow(_per_chunk(names, kinds, rows), ddl), "lines")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """h, did, line, __key of the earliest of lines that occur more than once, stored."""
    seen = lines.groupBy("h").agg(F.min(F.struct("did", "line", "__key")).alias("f"), F.count("*").alias("c")).where("c > 1")
    return stored(seen.select("h", "f.*"), "repeated-lines")


def _survivors(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """h, did, line, text of the earliest of each line that shares a half with another line, stored."""
    halves = lines.where(F.size("halves") > 0).select("h", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"), "shared-halves")
    few = F.broadcast(shared) if shared.count() <= BROADCAST_HALVES else shared
    with_place = lines.where(F.size("halves") > 0).select("h", "did", "line", "__key", F.explode("halves").alias("half"))
    return _texts(with_place.join(few, "half", "left_semi"), docs, "line-candidates")


def _by_size(df: DataFrame, lists: str) -> DataFrame:
    """``df``, which is stored, marked for broadcast if it and its lists are small."""
    size = df.agg(F.count("*") + F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_LINES else df.hint("merge")


def _texts(places: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """h, did, line, text of the earliest of each line, stored. ``places``: h, did, line, __key."""
    wanted = places.groupBy("h").agg(F.min(F.struct("did", "line", "__key")).alias("f"))
    by_doc = wanted.groupBy(F.col("f.__key").alias("__key"), F.col("f.did").alias("did")).agg(F.collect_list(F.struct(F.col("f.line").alias("line"), "h")).alias("wanted"))
    few = _by_size(stored(by_doc, "wanted-lines"), "wanted")
    texts = docs.select(row_key("doc_id", "text").alias("__key"), "text").join(few, "__key")

    @F.arrow_udf("array<string>")
    def pick(text: pa.Array, line: pa.Array) -> pa.Array:
        out = []
        for t, numbers in zip(text, line):  # one text at a time, as a batch's texts may be many
            parts = (t.as_py() or "").split("\n")
            out.append([parts[i] for i in numbers.as_py()])
        released()
        return pa.array(out, pa.list_(pa.string()))

    got = texts.select("did", "wanted", pick("text", F.col("wanted.line")).alias("picked"))
    each = got.select("did", F.explode(F.arrays_zip("wanted", "picked")).alias("x"))
    found = each.select(F.col("x.wanted.h").alias("h"), "did", F.col("x.wanted.line").alias("line"), F.col("x.picked").alias("text"))
    return stored(found.dropDuplicates(["h"]), name)


def _within(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most k words differ: replaced, put in or left out. Furthest places by diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    before: dict[int, int] = {}
    for edits in range(k + 1):
        now = {}
        for d in range(-edits, edits + 1):
            i = max(before.get(d, -k - 2) + 1, before.get(d - 1, -k - 2), before.get(d + 1, -k - 2) + 1) if edits else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if d == m - n and i == n:
                return True
            now[d] = i
        before = now
    return False


def near_lines(candidates: DataFrame) -> DataFrame:
    """h of the lines (h, did, line, text) that are one word edit from an earlier one."""

    def rows(part, lines):
        which, key, place = lines.variants(np.flatnonzero(lines.number == 0))
        take = lambda c: part.column(c).to_numpy()[which]
        return _signed(key), place, take("h"), take("did"), take("line")

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    emitted = candidates.mapInArrow(_per_chunk(["v", "place", "h", "did", "line"], kinds, rows), "v long, place int, h long, did long, line int")
    emitted = emitted.select("v", "place", "h", F.struct("did", "line").alias("at")).repartition("v")
    replaced = emitted.where("place >= 0").groupBy("v", "place").agg(F.min("at").alias("other"), F.count("*").alias("c")).where("c > 1")
    whole, part = F.when(F.col("place") < 0, F.col("at")), F.when(F.col("place") >= 0, F.col("at"))
    put_in = emitted.groupBy("v").agg(F.min(whole).alias("whole"), F.min(part).alias("part")).where("whole IS NOT NULL AND part IS NOT NULL")
    found = emitted.join(replaced, ["v", "place"]).select("h", "at", "other").unionByName(
        emitted.join(put_in, "v").select("h", "at", F.when(F.col("place") < 0, F.col("part")).otherwise(F.col("whole")).alias("other"))
    )
    pairs = found.where(F.col("other") < F.col("at")).select("h", "other").distinct()
    this = candidates.select("h", F.col("text").alias("this"))
    that = candidates.select(F.struct("did", "line").alias("other"), F.col("text").alias("that"))

    return pairs.join(this, "h").join(that, "other").where(_near()("this", "that")).select("h").distinct()


_TO_SPACE = {c: " " for c in range(0x09, 0x0E)}
#: Pairs of lines that one task compares.
PAIRS = 4000


def _near():
    """Whether two lines are near: first word by word, then by the words they have in common in any order, then by edit distance."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_pylist(), b.to_pylist()
        words = {t: [w for w in t.translate(_TO_SPACE).split(" ") if w] for t in {*x, *y}}
        count = functools.cache(lambda t: Counter(words[t]))
        out = []
        for t, u in zip(x, y):
            v, w = words[t], words[u]
            k = max(1, min(len(v), len(w)) // SHARE)
            replaced = len(v) == len(w) and sum(map(operator.ne, v, w)) <= k
            out.append(replaced or (count(t) & count(u)).total() >= max(len(v), len(w)) - k and _within(v, w, k))
        return pa.array(out, pa.bool_())

    return near.asNondeterministic()  # else the filter moves below the repartition, into a few tasks


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` with a key in ``keys``, which is stored and has each once."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_HALVES else keys, on, "left_semi")


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """Keys that more than one line has, stored. ``keys``: key, h."""
    return stored(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"), name)


def _later(lines: DataFrame, fits, verified, name: str) -> DataFrame:
    """h of the lines (keys, least, at, h and others) with an earlier line of the same key that fits and is verified, stored.

    Lines meet the earliest line of each of their ``least`` keys first, as near lines have most keys in
    common; those not found near then meet all earlier ones of all their ``keys``. So most lines of a
    large group do a few comparisons each. Two lines that have a ``least`` key in common, which is one of the
    ``keys``, then meet at the first such key only.
    """
    rest = [c for c in lines.columns if c not in ("keys", "least", "at", "h", "src")]
    earlier = (F.col("o.at") < F.col("l.at")) & (F.col("o.h") != F.col("l.h")) & fits
    by = lambda df, keys, *more: df.select(F.explode(keys).alias("key"), "at", "h", *rest, *more)

    def met(left: DataFrame, others: DataFrame, which: Column):
        pairs = left.alias("l").join(others.alias("o"), (F.col("l.key") == F.col("o.key")) & which)
        return verified(pairs.select(F.col("l.h").alias("h"), F.col("o.h").alias("other")).distinct()).select("h").distinct()

    least = by(lines, "least")
    first = least.groupBy("key").agg(F.min(F.struct("at", "h", *rest)).alias("f"), F.count("*").alias("c")).where("c > 1").select("key", "f.*")
    found = stored(met(least, stored(first, f"{name}-first"), earlier), f"{name}-found")
    known = found.withColumn("found", F.lit(True))
    every = by(lines.join(F.broadcast(known) if known.count() <= BROADCAST_HALVES else known, "h", "left"), "keys", "least", "found")
    once = F.coalesce(F.get(F.array_intersect("l.least", "o.least"), F.lit(0)) == F.col("l.key"), F.lit(True))
    # both sides have the same columns and rows, so that they are shuffled once; which of them meet is asked in the join
    which = F.when(F.col("l.found").isNull() & F.coalesce("o.found", F.lit(True)), earlier & once)
    return stored(found.unionByName(met(every, every, which)), name)


def _steps(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each of ``pairs`` with the line's step of length, and with the next: near lines with a pair in common have one of these in common."""
    step = np.floor(np.log(batch.column("n").to_numpy()) / np.log(STEP)).astype(np.uint64)
    pairs = longs(batch.column("pairs"))
    of = np.repeat(step, pairs.value_lengths().to_numpy())
    value = pairs.flatten().to_numpy().view(np.uint64)
    return [mix(value ^ mix(of + np.uint64(next_))) for next_ in (0, 1)]


def _of_like_length(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored, with ``parity`` as columns, and ``keys``: those of ``pairs`` that a line of another ``h`` and a like length ``n``
    has too, one at least; and ``least``: the least of the keys by each of ``LEAST`` orders."""
    bits = values_of_many(rows.select("h", "n", "pairs"), "pairs", "h", "pairs-of-like-length", _steps)
    kept = [c for c in rows.columns if c not in ("pairs", "parity")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = kept_of(longs(batch.column("pairs")), let_through(bits.value, _steps(batch)))
            some = pc.greater(keys.value_lengths(), 0)
            batch, keys = batch.filter(some), keys.filter(some)
            value, size = keys.flatten().to_numpy().view(np.uint64), keys.value_lengths().to_numpy()
            least = [np.zeros(0, np.uint64)] * LEAST
            if len(value):
                begin = np.cumsum(size) - size
                orders = [mix(value ^ np.uint64(i)) for i in range(LEAST)]
                least = [value[order == np.repeat(np.minimum.reduceat(order, begin), size)] for order in orders]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * LEAST, pa.int32()), pa.array(_signed(np.stack(least, 1).ravel())))
            parity = longs(batch.column("parity")).flatten().to_numpy().reshape(-1, len(PARITY))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, parity.T), keys, lists], names=[*kept, *PARITY, "keys", "least"])
        released()

    more = {**dict.fromkeys(PARITY, T.LongType()), **dict.fromkeys(("keys", "least"), T.ArrayType(T.LongType()))}
    return rows.mapInArrow(task, T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, kind) for c, kind in more.items()]]))


def wide_lines(lines: DataFrame, repeated: DataFrame, docs: DataFrame) -> DataFrame:
    """h of the lines of ``WIDE`` words and more that are near an earlier one of ``WIDE`` words and more."""
    wide = lines.where(F.length("pairs") > 0)
    bits = values_of_many(wide.select("h", "pairs"), "pairs", "h", "shared-pairs")
    some = only_held(wide.select("__key", "did", "line", "h", "n", "parity", "pairs"), "pairs", bits).where(F.length("pairs") > 0)
    first = repeated.select("h", F.struct("did", "line", "__key").alias("f"))
    some = some.join(F.broadcast(first) if first.count() <= BROADCAST_HALVES else first, "h", "left")
    some = some.where(F.col("f").isNull() | (F.col("f") == F.struct("did", "line", "__key")))  # of equal lines the earliest
    some = stored(some.drop("f"), "lines-of-shared-pairs")
    at = F.struct("did", "line").alias("at")
    rows = stored(_of_like_length(some).select("keys", "least", "h", at, "n", *PARITY, F.col("__key").alias("src")), "lines-of-like-length")
    discard(some)
    k = F.floor(F.least("l.n", "o.n") / SHARE)
    differ = lambda cs: functools.reduce(Column.__add__, [F.bit_count(functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"{o}{c}") for c in part for o in ("l.", "o.")])) for part in cs])
    short, long = [["p0"], ["p1"]], [*[[c] for c in PARITY[2:]], ["p0", "p2", "p4", "p6"], ["p1", "p3", "p5", "p7"]]
    fits = (F.abs(F.col("l.n") - F.col("o.n")) <= k) & (differ(short) <= 2 * k) & ((F.least("l.n", "o.n") < LONG) | (differ(long) <= 2 * k))

    def verified(pairs):
        pairs = stored(pairs, "line-pairs")
        tasks = pairs.count() // PAIRS + 1
        wanted = stored(pairs.select("h").unionByName(pairs.select(F.col("other").alias("h"))).distinct(), "paired-lines")
        places = _semi(rows, wanted, "h").select("h", "at.did", "at.line", F.col("src").alias("__key"))
        text = _texts(places, docs, "paired-texts").select("h", "text")
        both = pairs.join(text.withColumnRenamed("text", "this"), "h").join(text.select(F.col("h").alias("other"), F.col("text").alias("that")), "other")
        return both.repartition(tasks, "h", "other").where(_near()("this", "that"))

    return _later(rows, fits, verified, "wide-lines")


def short_lines(lines: DataFrame) -> DataFrame:
    """h of the lines of fewer than ``MIN_WORDS`` words that are near an earlier one."""

    def full(part, lines):
        of, key, word, chars = lines.short()
        raw = lines.data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(lines.words.begin[word].tolist(), lines.words.end[word].tolist())]
        did, line = (part.column(c).to_numpy()[of] for c in ("did", "line"))  # one line a row
        return _signed(key), _signed(lines.whole()[of]), did, line, lines.n[of], chars, words

    names, kinds = ["key", "h", "did", "line", "n", "chars", "word"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    said = lines.where("said IS NOT NULL").groupBy("h").agg(F.min(F.struct("did", "line", "said")).alias("f")).select("f.did", "f.line", F.col("f.said").alias("text"))
    rows = said.mapInArrow(_per_chunk(names, kinds, full), "key long, h long, did long, line int, n int, chars int, word string")
    rows = stored(rows.distinct().select("key", "h", F.struct("did", "line").alias("at"), "n", "chars", "word"), "short-rows")
    rows = _semi(rows, _shared(rows.select("key", "h"), "shared-words"), "key").withColumns({"keys": F.array("key"), "least": F.array("key")}).drop("key")
    k = F.floor(F.least("l.chars", "o.chars") / SHARE)
    fits = (F.col("l.n") == F.col("o.n")) & (F.abs(F.col("l.chars") - F.col("o.chars")) <= k) & (F.levenshtein("l.word", "o.word") <= k)
    return _later(rows, fits, lambda pairs: pairs, "short-lines")


def removals(docs: DataFrame) -> DataFrame:
    """__key (``row_key`` of the document) and gone: the numbers, from 0, of its lines that go."""
    lines = line_table(docs)
    repeated = repeated_lines(lines)
    near = near_lines(_survivors(lines, docs)).unionByName(wide_lines(lines, repeated, docs)).unionByName(short_lines(lines))
    again = repeated.select("h", F.struct("did", "line").alias("first"))
    seen = stored(again.join(near.select("h", F.lit(True).alias("near")).distinct(), "h", "full_outer"), "lines-that-go")
    seen = F.broadcast(seen) if seen.count() <= BROADCAST_HALVES else seen
    gone = lines.join(seen, "h").where(F.coalesce("near", F.struct("did", "line") > F.col("first")))
    return stored(gone.groupBy("__key").agg(F.sort_array(F.collect_set("line")).alias("gone")), "line-removals")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later copies of lines left out of ``text``, and the columns n_lines and n_removed."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cut(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
            drop = set(gone[i].as_py())
            out.append("\n".join(x for n, x in enumerate(text[i].as_py().split("\n")) if n not in drop))
        kept = pc.replace_with_mask(text, gone.is_valid(), pa.array(out, text.type)).cast(pa.string())
        released()
        return kept

    gone = _by_size(removals(docs).withColumnRenamed("gone", "__gone"), "__gone")
    out = docs.drop("n_lines", "n_removed").withColumn("__key", row_key("doc_id", "text")).join(gone, "__key", "left")
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    out = out.withColumns({"n_lines": F.coalesce(lines, F.lit(1)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    kept = cut(F.when(F.col("__gone").isNotNull(), F.col("text")), "__gone")  # only texts with lines that go are sent to a worker
    return out.withColumn("text", F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("text"))).drop("__key", "__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: lines of every document, lines that go, and the digest of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of lines; n_chars follows the text."""
    return dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


#: Words (or characters) put in, left out or replaced between two lists of n and m, by the usual table, row by row.
_EDITS = lambda a, b, n, m: f"list_reduce(list_transform(range(1, {n} + 1), lambda i: [i]), lambda r, x: list_reduce(list_transform(range(1, {m} + 1), lambda j: [least(r[j + 1] + 1, r[j] + ({a}[x[1]] <> {b}[j])::BIGINT)]), lambda s, y: list_append(s, least(s[-1] + 1, y[1])), [r[1] + 1]), range(0, {m} + 1))[-1]"
ORACLE = f"""
WITH li AS (SELECT doc_id, i - 1 AS line, string_split(coalesce(text, ''), chr(10))[i] AS t
            FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)),
w AS (SELECT doc_id, line, t, list_filter(string_split_regex(t, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM li),
d AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars, greatest(1, len(w) // 10) AS k, row_number() OVER () AS id
      FROM (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((doc_id, line)) AS f FROM w WHERE len(w) > 0 GROUP BY 1)),
tk AS (SELECT id, n, k, f, x || chr(1) || row_number() OVER (PARTITION BY id, x ORDER BY i) AS tok, x FROM (SELECT id, n, k, f, i, w[i] AS x FROM d, unnest(range(1, n + 1)) AS r(i) WHERE n >= 8)),
rare AS (SELECT x, count(*) AS c FROM tk GROUP BY x),
px AS (SELECT * FROM (SELECT id, n, k, f, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS rk FROM tk JOIN rare USING (x)) WHERE rk <= k + 1),
pr AS (SELECT DISTINCT a.id AS a, b.id AS b, least(a.k, b.k) AS k FROM px a JOIN px b ON a.tok = b.tok AND b.f < a.f AND abs(a.n - b.n) <= least(a.k, b.k)),
ov AS (SELECT a, b, any_value(pr.k) AS k, count(*) AS same FROM pr JOIN tk u ON u.id = a JOIN tk v ON v.id = b AND v.tok = u.tok GROUP BY a, b),
nl AS (SELECT DISTINCT x.s FROM ov JOIN d x ON x.id = a JOIN d y ON y.id = b WHERE same >= greatest(x.n, y.n) - ov.k AND {_EDITS('x.w', 'y.w', 'x.n', 'y.n')} <= ov.k),
sv AS (SELECT id, n, chars, f, s, p, w[p] AS word, array_to_string(list_concat(w[1:p - 1], [chr(1)], w[p + 1:]), ' ') AS v FROM d, unnest(range(1, n + 1)) AS r(p) WHERE n < 8),
sp AS (SELECT x.s, least(x.chars, y.chars) // 10 AS k, string_split(x.word, '') AS a, string_split(y.word, '') AS b FROM sv x JOIN sv y ON x.v = y.v AND x.n = y.n AND y.f < x.f AND abs(length(x.word) - length(y.word)) <= least(x.chars, y.chars) // 10),
ns AS (SELECT DISTINCT s FROM sp WHERE k > 0 AND {_EDITS('a', 'b', 'len(a)', 'len(b)')} <= k),
n AS (SELECT s FROM nl UNION SELECT s FROM ns),
g AS (SELECT w.doc_id, w.line, w.t, coalesce(d.f < (w.doc_id, w.line) OR d.s IN (SELECT s FROM n), false) AS gone
      FROM w LEFT JOIN d ON d.s = array_to_string(w.w, ' '))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
