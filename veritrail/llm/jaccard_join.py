"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two sets link if their Jaccard
similarity is at least ``THRESHOLD`` percent. The operator returns the components of these links.

1. Equal sets are one member from here on.
2. Shingles are ordered by how often they occur, the frequent ones last (counted over all texts; the
   order only decides speed). Sets that link share one of their first n - ceil(0.8 n) + 1 shingles.
3. Groups: members with a common min-hash are compared with ``PIVOTS`` of them; those that link are a
   group, so a large family of near copies is put together by a few comparisons for each member.
   Sets that link with none of those lie in loose groups of a common min-hash and like sizes. Groups are
   kept in parts of about ``GROUP`` members.
4. Token-group matrix: for each of the first shingles, the groups that hold it. Shingles that only one
   group holds are left out by a Bloom filter. A set is a candidate for the other groups that hold one of
   its first shingles and have members of a fitting size.
5. Each group's union of shingles is stored as a bitmap: bit (hash modulo width) of four bits a shingle
   or more. A candidate meets the union first: the bits in common, and the shingles that share a bit, bound
   the overlap with any member from above. If that is less than the threshold asks for, no member can
   link, and the group is not opened. Only for qualifying groups are texts fetched and sets compared.

All links between different groups and within loose groups are tested, and other groups hang together by
links, so the components are those of all links. No list of all pairs of a group is made.

Defined results: texts without words (null, empty, blank) have an empty set and link with nothing; with
fewer than 5 words the whole sequence is one shingle; a null doc_id counts as the largest and gets a
component_id only from others; rows equal in id and text are two documents with equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import SPACES, Words, chunks, column_bytes, discard, frequent, mix, only_held, row_key, small_batches, stored, values_of_many

SHINGLE = 5
THRESHOLD = 80
GROUP = 64
#: Queries that meet a group in one go; more are dealt out.
QUERIES = 256
HASHES = 3
#: Members of each min-hash with which its others are compared.
PIVOTS = 4
#: Documents to be fetched are broadcast by key up to so many (a fourth as many jobs), else joined by shuffle.
BROADCAST_KEYS = 1_000_000
_LAST = 2**63 - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash), by text and hash."""
    words = Words(data, offsets, SPACES)
    w, n = words.hash, words.count
    total = max(0, len(w) - SHINGLE + 1)
    h = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + total] * _ODD[k]
    text = words.text[:total]
    inside = text == words.text[SHINGLE - 1 :][:total]
    h, text = mix(h[inside]), text[inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = n[short] > k
            own[has] += w[words.first[short[has]] + k] * _ODD[k]
        own = mix(own + mix(n[short].astype(np.uint64)))
        h, text = np.concatenate((h, own)), np.concatenate((text, short))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[fresh], h[fresh]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(batch.column("text"))
    for a, b in chunks(np.diff(offsets)):
        text, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, text, h


_MEMBER = "__key long, doc_id long, n long, sig long, mins array<long>, prefix array<long>, bits array<long>"


def bitmaps(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's bitmap ends, and all of them: 64-bit words, a power of two, four bits a shingle at least."""
    size = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(4 * n, 64) / 64)).astype(np.int64), 0)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    bit = h & (size[text] * 64 - 1).astype(np.uint64)
    np.bitwise_or.at(out, (ends - size)[text] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return ends, out


def members(docs: DataFrame) -> DataFrame:
    """__key, doc_id, size of the set, its signature, min-hashes, first shingles and bitmap: one row for each document, stored."""
    texts = docs.select(row_key("doc_id", "text").alias("__key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.sparkSession.sparkContext.broadcast(frequent(texts, lambda data, offsets: shingle_sets(data, offsets)[1], "frequent-shingles"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = known.value
        for batch in batches:
            for a, b, text, h in _texts(batch):
                n = np.bincount(text, minlength=b - a)
                first = np.cumsum(n) - n
                some = np.flatnonzero(n > 0)
                sig, mins = np.zeros(b - a, np.uint64), np.zeros((HASHES, b - a), np.uint64)
                if len(some):
                    sig[some] = mix(np.add.reduceat(mix(h ^ np.uint64(0x1234567)), first[some]) + n[some].astype(np.uint64))
                    for k in range(HASHES):
                        mins[k, some] = mix(np.minimum.reduceat(mix(h ^ np.uint64(1000003 * (k + 1))), first[some]) + np.uint64(k))
                often = np.zeros(len(h), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    often = np.where(tokens[at] == h, counts[at], 0)
                order = np.lexsort((often, text)) if often.any() else np.arange(len(h))  # stable: by hash among equals
                length = np.where(n > 0, n - (THRESHOLD * n + 99) // 100 + 1, 0)
                place = np.arange(len(h)) - first[text]
                kept = h[order][place < length[text]]
                lists = lambda ends, v: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(sig.view(np.int64)),
                     lists(np.arange(1, b - a + 1) * HASHES, mins.T.ravel()), lists(np.cumsum(length), kept), lists(*bitmaps(text, h, n))],
                    names=["__key", "doc_id", "n", "sig", "mins", "prefix", "bits"],
                )

    return stored(texts.mapInArrow(task, _MEMBER), "shingle-members")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Both sorted and distinct."""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group lie together, its members first: links of its queries to its members."""
    here, sets, union = None, [], None
    for batch in batches:
        links: list[tuple[int, int]] = []
        g, part, query, sig = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "part", "query", "sig"))
        for a, b, text, h in _texts(batch):
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=b - a))))
            for i in range(a, b):
                own = h[ends[i - a] : ends[i - a + 1]]
                if here != (g[i], part[i]):
                    here, sets, union = (g[i], part[i]), [], None
                if not query[i]:
                    sets.append((sig[i], own.copy()))
                    continue
                if len(sets) > 1:
                    if union is None:
                        union = np.unique(np.concatenate([s for _, s in sets]))
                    at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                    if 100 * int((union[at] == own).sum()) < THRESHOLD * len(own):
                        continue
                links += [(sig[i], s) for s, other in sets if s != sig[i] and _linked(own, other)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _folded(bits: Column, words: Column) -> Column:
    """A bitmap of ``words`` or twice as many, as one of ``words``."""
    half = F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) > words, half).otherwise(bits)


def unions(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """g, union, least, spare: each group's union of shingles as a bitmap, its smallest set, and the most
    shingles of a set that share a bit. ``groups``: g, sig (about ``GROUP`` of them, of one bitmap width)."""
    own = F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))
    rows = groups.join(sets.select("sig", "n", "bits", (F.col("n") - own).alias("spare")), "sig")
    merged = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda u, x: F.zip_with(u, x, lambda a, b: a.bitwiseOR(b)))
    every = rows.groupBy("g").agg(F.collect_list("bits").alias("all"), F.min("n").alias("least"), F.max("spare").alias("spare"))
    return stored(every.select("g", merged.alias("union"), "least", "spare"), "group-unions")


def qualifying(candidates: DataFrame, sets: DataFrame, unions: DataFrame) -> DataFrame:
    """sig, g of the candidates whose overlap with the group's union may reach the threshold, stored."""
    rows = candidates.join(sets.select("sig", "n", "bits"), "sig").join(unions, "g")
    words = F.least(F.size("bits"), F.size("union"))
    rows = rows.select("sig", "g", "n", "least", "spare", (F.size("union") > words).alias("halved"), _folded(F.col("bits"), words).alias("q"), _folded(F.col("union"), words).alias("u"))
    both = F.aggregate(F.zip_with("q", "u", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, x: n + x)
    spare = F.col("n") - F.aggregate("q", F.lit(0), lambda n, x: n + F.bit_count(x))
    # the group's own spare is of its full width and bounds nothing where the union is folded
    rows = rows.select("sig", "g", "n", "least", (both + F.when(F.col("halved"), spare).otherwise(F.least(spare, "spare"))).alias("most"))
    return rows.where((100 + THRESHOLD) * F.col("most") >= THRESHOLD * (F.col("n") + F.col("least"))).select("sig", "g")


def links(candidates: DataFrame, groups: DataFrame, sets: DataFrame, docs: DataFrame, once: bool) -> DataFrame:
    """a, b: signatures of sets that link, stored.

    ``candidates``: sig, g; ``groups``: g, sig (its members); ``sets``: sig, __key of one document with
    the set. Candidates meet the groups' unions first. Texts are then fetched by document, each of them
    ``once``, and each group's queries dealt to parts of about ``QUERIES``.
    """
    few = groups.join(candidates.select("g").distinct(), "g")
    asked = stored(qualifying(candidates, sets, unions(few, sets)), "group-candidates")
    parts = asked.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    job = lambda g, part, query: [g, part.alias("part"), F.lit(query).alias("query")]
    queries = asked.join(parts, "g").select("sig", *job("g", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"), True))
    held = groups.join(parts, "g").select("sig", *job("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), False))
    jobs = stored(queries.unionByName(held).join(sets.select("sig", "__key"), "sig"), "join-jobs")
    wanted = stored(jobs.select("__key").distinct(), "join-documents")
    texts = docs.select(row_key("doc_id", "text").alias("__key"), "text")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted.hint("merge"), "__key", "left_semi")
    if not once:
        texts = texts.dropDuplicates(["__key"])
    rows = texts.join(F.broadcast(jobs) if jobs.count() <= BROADCAST_KEYS // 4 else jobs.hint("merge"), "__key").select("g", "part", "query", "sig", "text")
    dealt = rows.repartition("g", "part").sortWithinPartitions("g", "part", "query", "sig")
    return stored(dealt.mapInArrow(_open, "a long, b long"), "set-links")


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The members; node (signature), label of its group for sets that link with a pivot; and node (such a
    label, or a signature without one), label for those that link with others across groups."""
    full = members(docs)
    every = stored(full.select("__key", "doc_id", "n", "sig"), "set-of-document")
    once = every.groupBy("__key").count().where("count > 1").isEmpty()
    of_set = [F.min("__key").alias("__key"), *[F.first(c).alias(c) for c in ("n", "mins", "prefix", "bits")]]
    sets = stored(full.where("n > 0").groupBy("sig").agg(*of_set), "distinct-sets")
    discard(full)
    # groups: compare with a few of those that share a min-hash, the same few for all of them
    by_min = sets.select("sig", "n", F.explode("mins").alias("m"))
    few_of = F.array_distinct(F.array(*[F.min_by(F.struct(F.col("sig").alias("g"), F.col("n").alias("g_n")), F.xxhash64("sig", F.lit(k))) for k in range(PIVOTS)]))
    pivots = stored(by_min.groupBy("m").agg(few_of.alias("g"), F.count("*").alias("c")).where("c > 1").select("m", F.inline("g")), "pivots")
    like = 100 * F.least("n", "g_n") >= THRESHOLD * F.greatest("n", "g_n")
    star = by_min.join(pivots, "m").where((F.col("sig") != F.col("g")) & like).select(F.greatest("sig", "g").alias("sig"), F.least("sig", "g").alias("g")).distinct()
    star = stored(star, "star-candidates")
    near = links(star, star.select("g").distinct().select("g", F.col("g").alias("sig")), sets, docs, once)
    # one edge a member, to the least pivot that it links with, and edges among those pivots
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))  # HASHES * PIVOTS at most
    chains = least.select("m", F.explode("all").alias("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    labels = components(least.select("a", F.col("m").alias("b")).unionByName(chains))
    # a group is what hangs together so far; sets that hang with nothing yet lie in loose groups of a common min-hash
    small = sets.select("sig", F.size("bits").alias("width"), F.get("mins", F.lit(0)).alias("m0"))
    small = small.join(labels.select(F.col("node").alias("sig"), F.col("label").alias("cluster")), "sig", "left").select(
        "sig", "width", F.coalesce("cluster", "sig").alias("cluster"), F.coalesce("cluster", "m0").alias("home"), F.col("cluster").isNull().alias("loose")
    )
    small = stored(small, "set-homes")
    size = small.groupBy("home", "loose").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / GROUP))
    group = F.xxhash64("home", "loose", "width", part).alias("g")
    homes = stored(small.join(size, ["home", "loose"]).select("sig", "cluster", "home", "loose", "size", group), "set-groups")
    # token-group matrix of the first shingles, without those that one group alone holds
    rows = stored(sets.select("sig", "n", "prefix").join(homes, "sig"), "set-prefixes")
    bits = values_of_many(rows.select("prefix", "cluster"), "prefix", "cluster", "shared-shingles")
    held = only_held(rows.select("sig", "n", "home", "loose", "size", "g", "prefix"), "prefix", bits)
    held = stored(held.select("sig", "n", "home", "loose", "size", "g", F.explode("prefix").alias("t")), "matrix-rows")
    discard(rows)
    matrix = held.groupBy("t", *[F.col(c).alias(f"g_{c}") for c in ("home", "loose", "size", "g")]).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = stored(matrix, "token-groups")
    fits = (100 * F.col("most") >= THRESHOLD * F.col("n")) & (THRESHOLD * F.col("least") <= 100 * F.col("n"))
    # each pair of groups once, the smaller one asking; a loose home of several sets asks itself too
    order = F.struct("size", "home", "loose") < F.struct("g_size", "g_home", "g_loose")
    own = F.col("loose") & F.col("g_loose") & (F.col("home") == F.col("g_home")) & (F.col("size") > 1)
    asked = stored(held.join(matrix, "t").where((order | own) & fits).select("sig", F.col("g_g").alias("g")).distinct(), "matrix-candidates")
    across = links(asked, homes.select("g", "sig"), sets, docs, once)
    # links between what hangs together already
    name = lambda side: F.coalesce(F.col(f"{side}_label"), F.col(side)).alias(side)
    for side in ("a", "b"):
        across = across.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
    return every, labels, components(across.select(name("a"), name("b")))


def _first(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_LAST))


def join(docs: DataFrame) -> DataFrame:
    """__key, doc_id, n_shingles, component_id: one row for each document."""
    every, labels, more = linked_sets(docs)
    sets = every.select("__key", "doc_id", "n", "sig").join(labels.select(F.col("node").alias("sig"), F.col("label").alias("group")), "sig", "left")
    sets = sets.withColumn("group", F.coalesce("group", "sig")).join(more.withColumnRenamed("node", "group"), "group", "left")
    sets = sets.withColumn("c", F.when(F.col("n") > 0, F.coalesce("label", "group")))
    # the least id of each component; sets of one document alone are settled without a join
    least = sets.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component"), F.count("*").alias("k")).where("k > 1").select("c", "component")
    least = stored(least, "component-ids")
    out = sets.join(least, "c", "left")
    return out.select("__key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "c")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the least doc_id (then the least key). Documents with
    an empty set all stay."""
    found = stored(join(docs), "components-of-documents")
    stay = found.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct(_first(F.col("doc_id")).alias("d"), "__key")).alias("m"), F.count("*").alias("k"), F.countDistinct("__key").alias("keys"))
    gone = found.join(stay.where("k > 1").select("c", F.col("m.__key").alias("keep")), "c").where("__key <> keep").select("__key").distinct()
    out = docs.withColumn("__key", row_key("doc_id", "text")).join(gone, "__key", "left_anti")
    if not stay.where("keys < k").isEmpty():  # rows equal in id and text
        again = found.where("c IS NOT NULL").groupBy("__key").count().where("count > 1").select("__key", F.lit(True).alias("__again"))
        out = out.join(again, "__key", "left")
        twice = out.where("__again").dropDuplicates(["__key"])
        out = out.where("__again IS NULL").unionByName(twice)
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's set size and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    small_batches(spark)
    return dedup(docs)
