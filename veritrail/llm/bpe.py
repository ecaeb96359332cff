"""BPE encoding and decoding by speculation and verification.

For every new word (pre-token) a greedy longest match proposes tokens. A token sequence is what BPE
would give exactly when each adjacent pair is: undoing the two tokens' merges from the last to the
first, no merge across their border may come before the merges that are still made. That test runs
vectorised over all adjacent pairs; only words with a failing pair are merged exactly.

Ids travel as little-endian unsigned 32-bit integers in a binary column. The vocabulary file's path is
a parameter; it is read on the workers once per process (a byte-level BPE file of the ``tokenizers``
library: vocab, merges, one pre-tokenizer, special tokens).

Defined results: null and empty texts have no ids; strings of special tokens inside a text become
their ids, as the library does by default; repeated rows give equal rows; other columns pass through
(a clashing ``ids`` or output column is replaced).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, released, small_batches

#: The split pattern of byte-level BPE, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A run of white space (as Unicode defines it) and what follows up to the next; pre-tokens never cross from the latter to the former.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))
RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Runs whose tokens a worker remembers, ids of them, runs of a long text worked on at once, and bytes of a word merged in columns.
RUNS_REMEMBERED, RUN_IDS, RUNS_AT_ONCE, COLUMNS = 1_000_000, 8_000_000, 500_000, 48
#: Words whose tokens a worker remembers, after which it starts anew.
REMEMBERED = 150_000
#: Bytes of texts or ids worked on at once.
PIECE_BYTES = 1 << 20
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a file, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, i in vocab.items():
            self.token[i] = as_bytes(token)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.id_of_byte = np.full(256, -1, np.int64)
        for c, b in letters.items():
            if c in vocab:
                self.id_of_byte[b] = vocab[c]
        # merge tables: rank, parts and outcome of each merge, by the pair merged and by the token made
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size = size
        self.made = made
        pair = left * size + right
        self.ranks = dict(reversed(list(zip(pair.tolist(), range(len(made))))))
        order = np.argsort(pair, kind="stable")
        self.pair, self.pair_rank = pair[order], order.astype(np.int64)
        self.made_rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for table, value in ((self.made_rank, np.arange(len(made))), (self.left, left), (self.right, right)):
            table[made[::-1]] = value[::-1]  # a token made by several merges keeps the first
        # tokens that BPE makes of their own bytes; the others are never proposed
        natural = self.made_rank < 0
        composed = np.flatnonzero(~natural)
        whole = self._joined(self.left[composed], self.right[composed], own=True)
        for t in composed[np.argsort(self.made_rank[composed])].tolist():
            natural[t] = natural[self.left[t]] and natural[self.right[t]]
        natural[composed] &= whole
        self.greedy = ahocorasick.Automaton()
        for i in vocab.values():
            if natural[i]:
                self.greedy.add_word(self.token[i].decode("latin-1"), i)
        self.greedy.make_automaton()
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.bytes_flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.bytes_len = np.array([len(t) for t in self.token], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.forget()
        self.forget_runs()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.all_ids, self.all_len, self.all_at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget_runs(self) -> None:
        self.run_index: dict[str, int] = {}
        self.run_ids, self.run_len, self.run_at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1) if len(self.pair) else np.zeros(len(key), int)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NEVER) if len(self.pair) else np.full(len(key), _NEVER)

    def _joined(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether BPE keeps each a and b apart as they are (own: joins them last of all).

        Merges are undone from the latest: on the left of the border the right part stays at it, on
        the right the left part. A merge over the border wins if it ranks before the one undone last;
        of equal ranks the one further left goes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER, np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        first = own
        while len(live):
            if not first:
                bad = self._rank(a[live], b[live]) < limit[live]
                good[live[bad]] = False
                live = live[~bad]
            first = False
            x, y = self.made_rank[a[live]], self.made_rank[b[live]]
            more = (x >= 0) | (y >= 0)
            live, x, y = live[more], x[more], y[more]
            on_left = x > y
            i, j = live[on_left], live[~on_left]
            limit[i], limit[j] = x[on_left], y[~on_left] + 1
            a[i], b[j] = self.right[a[i]], self.left[b[j]]
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if len(word) > 1000:
            return self._exact_long(word)
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        get, size, made = self.ranks.get, self.size, self.made
        rank = [get(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while rank and (least := min(rank)) < _NEVER:
            i = rank.index(least)
            ids[i : i + 2] = [new := int(made[least])]
            del rank[i]
            if i:
                rank[i - 1] = get(ids[i - 1] * size + new, _NEVER)
            if i < len(rank):
                rank[i] = get(new * size + ids[i + 1], _NEVER)
        return ids

    def _exact_long(self, word: bytes) -> list[int]:
        """The same with a heap, whose time does not grow with the square of the length."""
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, size, ranks = len(ids), self.size, self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := ids[i] * size + ids[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, p = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] * size + ids[j] != p:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := ids[k] * size + ids[after[k]]) in ranks:
                    heapq.heappush(heap, (ranks[q], k, q))
        return [x for x in ids if x >= 0]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact tokens of all words in a row, and their number for each.

        Words of equal length are the rows of a matrix. Each round merges, in every row, the pair of lowest
        rank, the leftmost first, so all rows lose one column; rows with nothing to merge are done.
        """
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        count = np.zeros(len(raw), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(size, kind="stable")
        for at in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1) if len(raw) else ():
            m = int(size[at[0]])
            if m > COLUMNS:
                done += [(at[k : k + 1], np.array([self.exact(raw[i])], np.int64)) for k, i in enumerate(at.tolist())]
                continue
            ids = self.id_of_byte[np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(-1, m)]
            rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), m - 1)
            while len(at):
                width = ids.shape[1]
                best = rank.argmin(1) if width > 1 else np.zeros(len(at), np.int64)
                row = np.arange(len(at))
                least = rank[row, best] if width > 1 else np.full(len(at), _NEVER)
                if (ended := least == _NEVER).any():
                    done.append((at[ended], ids[ended]))
                    going = ~ended
                    at, ids, rank, best, least, row = at[going], ids[going], rank[going], best[going], least[going], row[: int(going.sum())]
                if not len(at):
                    break
                ids[row, best] = self.made[least]
                keep = np.ones(ids.shape, bool)
                keep[row, best + 1] = False
                ids = ids[keep].reshape(len(at), -1)
                rank = rank[keep[:, 1:]].reshape(len(at), -1)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
                rank[left, best[left] - 1] = self._rank(ids[left, best[left] - 1], ids[left, best[left]])
                rank[right, best[right]] = self._rank(ids[right, best[right]], ids[right, best[right] + 1])
        for at, ids in done:
            count[at] = ids.shape[1]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for at, ids in done:
            out[begin[at][:, None] + np.arange(ids.shape[1])] = ids
        return out, count

    def _learn_runs(self, new: list[str]) -> None:
        """Tokens of runs not met before; a special token's string is a word of its own."""
        # runs from white space to a letter or mark can stand in a row: the pre-tokens of each are what they are alone
        alone = [run for run in new if run[0] not in SPACES or run[-1] in SPACES]
        if self.splitter and self.splitter.search("\0".join(new)):
            alone += [run for run in new if run[0] in SPACES and run[-1] not in SPACES and self.splitter.search(run)]
        if alone:
            apart = set(alone)
            new = [run for run in new if run not in apart]
        words = self.words.findall("".join(new))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))) + 1
        counts = np.concatenate((np.diff(last, prepend=0), np.zeros(len(alone), np.int64)))
        special: list[int] = []
        for k, run in enumerate(alone, len(new)):
            before = len(words)
            for j, piece in enumerate(self.splitter.split(run) if self.splitter else (run,)):
                if j % 2:
                    special.append(len(words))
                    words.append(piece)
                else:
                    words += self.words.findall(piece)
            counts[k] = len(words) - before
        new = new + alone
        different = list(dict.fromkeys(words))
        place = dict(zip(different, range(len(different))))
        ids, size = self.merged(different)
        begin = np.cumsum(size) - size
        for text in {words[k] for k in special}:
            at = place[text]
            ids, size[at], begin[at] = np.append(ids, np.uint32(self.special[text])), 1, len(ids)
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        length = size[at]
        ends = np.cumsum(length)
        where = np.repeat(begin[at] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.run_index.update(zip(new, range(len(self.run_index), len(self.run_index) + len(new))))
        run_end = np.concatenate(([0], ends))[np.cumsum(counts)]
        self.run_ids = np.concatenate((self.run_ids, ids[where]))
        self.run_len = np.concatenate((self.run_len, np.diff(run_end, prepend=0)))
        self.run_at = np.cumsum(self.run_len) - self.run_len

    def _of_runs(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs in a row, and their number for each."""
        if len(self.run_index) > RUNS_REMEMBERED or len(self.run_ids) > RUN_IDS:
            self.forget_runs()
        at = np.fromiter(map(self.run_index.get, found, repeat(-1)), np.int64, len(found))
        if len(missing := np.flatnonzero(at < 0)):
            lacking = [found[i] for i in missing.tolist()]
            self._learn_runs(list(dict.fromkeys(lacking)))
            at[missing] = np.fromiter(map(self.run_index.__getitem__, lacking), np.int64, len(lacking))
        size = self.run_len[at]
        ends = np.cumsum(size)
        where = np.repeat(self.run_at[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.run_ids[where].astype("<u4"), size

    def encode_runs(self, texts: list[str | None]) -> list[bytes]:
        """The same ids as ``encode``, by runs that are remembered; words met anew are merged together, in columns."""
        if sum(len(t or "") for t in texts) > 4 * PIECE_BYTES:
            out = []
            for text in texts:
                runs = RUNS.finditer(text or "")
                parts = iter(lambda: [m.group() for m in islice(runs, RUNS_AT_ONCE)], [])
                out.append(b"".join(self._of_runs(part)[0].tobytes() for part in parts))
            return out
        found: list[str] = []
        counts = []
        for text in texts:
            runs = RUNS.findall(text) if text else []
            found += runs
            counts.append(len(runs))
        ids, size = self._of_runs(found)
        last = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]

    def learn(self, new: list[str]) -> None:
        """Tokens of words not met before: propose, test all adjacent pairs, merge what fails."""
        raw = [w.encode() for w in new]
        size = np.array([len(w) for w in raw])
        begin = np.cumsum(size + 1) - size - 1
        line = b"\xff".join(raw).decode("latin-1").replace("\xff", "\u0100")  # 0xFF is in no UTF-8 text
        found = np.array(list(self.greedy.iter_long(line)), np.int64).reshape(-1, 2)
        ids = found[:, 1]
        word = np.searchsorted(begin, found[:, 0], side="right") - 1
        failed = np.bincount(word, self.bytes_len[ids], minlength=len(new)) != size  # not covered by proposals
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        failed[word[inner[~self._joined(pairs // self.size, pairs % self.size)[back]]]] = True
        count = np.bincount(word, minlength=len(new))
        anew = [self.exact(raw[w]) for w in np.flatnonzero(failed).tolist()]
        keep = ~failed[word]
        count[failed] = [len(x) for x in anew]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]), np.uint32)
        of = np.repeat(failed, count)
        out[~of] = ids[keep]
        out[of] = [t for x in anew for t in x]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.all_ids = np.concatenate((self.all_ids, out))
        self.all_len = np.concatenate((self.all_len, count))
        self.all_at = np.cumsum(self.all_len) - self.all_len

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.index) > REMEMBERED:
            self.forget()
        found, counts = [], []
        for text in texts:
            pieces = self.splitter.split(text) if text and self.splitter else [text or ""]
            n = 0
            for k, piece in enumerate(pieces):
                words = [piece] if k % 2 else self.words.findall(piece)
                found += words
                n += len(words)
                if k % 2 and piece not in self.index:
                    self.index[piece] = len(self.index)
                    self.all_ids = np.append(self.all_ids, np.uint32(self.special[piece]))
                    self.all_len = np.append(self.all_len, 1)
                    self.all_at = np.cumsum(self.all_len) - self.all_len
            counts.append(n)
        get = self.index.get
        at = np.array([get(w, -1) for w in found], np.int64)
        if len(missing := np.flatnonzero(at < 0)):
            self.learn(list(dict.fromkeys(found[i] for i in missing.tolist())))
            at[missing] = [get(found[i]) for i in missing.tolist()]
        size = self.all_len[at]
        ends = np.cumsum(size)
        where = np.repeat(self.all_at[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.all_ids[where].astype("<u4")
        last = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))] if len(texts) else np.zeros(1, int)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]

    def decode(self, ids: bytes | None) -> bytes:
        t = np.frombuffer(ids or b"", "<u4").astype(np.int64)
        size = self.bytes_len[t]
        ends = np.cumsum(size)
        where = np.repeat(self.bytes_at[t] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes_flat[where].tobytes()


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names} | {name: values}
    return pa.RecordBatch.from_arrays([columns[n] for n in schema], names=list(schema))


def _mapped(df: DataFrame, name: str, kind: T.DataType, source: str, of_batch) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, PIECE_BYTES):
                part = batch.slice(a, b - a)
                yield _with(part, name, of_batch(part), names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` in the binary column ``out``."""

    def of_batch(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(vocabulary(path).encode(batch.column(text_col).to_pylist()), pa.binary())

    return _mapped(df, out, T.BinaryType(), text_col, of_batch)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out``; bytes that are not UTF-8 become U+FFFD."""

    def of_batch(batch: pa.RecordBatch) -> pa.Array:
        v = vocabulary(path)
        raw = [v.decode(x.as_py()) for x in batch.column(ids_col)]
        try:
            return pc.cast(pa.array(raw, pa.binary()), pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())

    return _mapped(df, out, T.StringType(), ids_col, of_batch)


def round_trip(df: DataFrame, path: str, text_col: str = "text", forget: bool = False) -> DataFrame:
    """``df`` with ``ids`` and with ``decoded``, the text decoded from them, in one pass: one worker for each task.

    ``forget``: a worker drops its vocabulary (about 70 MB) after the task, as other stages run in it too.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("ids", "decoded")] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, PIECE_BYTES):
                part = batch.slice(a, b - a)
                ids = v.encode(part.column(text_col).to_pylist())
                part = _with(part, "ids", pa.array(ids, pa.binary()), [n for n in schema.names if n != "decoded"])
                yield _with(part, "decoded", pa.array([v.decode(x).decode("utf-8", "replace") for x in ids], pa.string()), schema.names)
        if forget:
            del v
            _LOADED.clear()
            released()

    return df.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op4: digests of every document's ids and of the text decoded from them."""
    path = path or default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Last stage: every document's ids in place of its text, with their number, digest and the decoded text's digest."""
    small_batches(spark)
    path = path or default_path()
    out = round_trip(docs, path, forget=True).drop("text")
    return out.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")
