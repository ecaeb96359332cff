"""Retrieval and ranking of evidence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import text as T
from ..session import spread, stored
from .prose import ENTRIES, distinct, ranges, runs, shared_words_blocked
from .vectors import nearest

#: A word in more ids and in more facts than that is frequent: its ids never meet its facts pair by pair.
OFTEN = 1000
#: Claims that meet one copy of a document, about, and such rows in a task.
CLAIMS_AT_ONCE, DOCUMENTS_AT_ONCE = 1000, 100
#: Words that are looked for in a text one by one, at most.
FEW_WORDS = 16
#: Items of a claim that are compared in one array, at most.
TOGETHER = 64
#: Java's ASCII white space, and the ends of lines that are none.
_SPACE, _LINE_ENDS = " \t\n\x0b\f\r", "\u0085\u2028\u2029"
_AFTER_MARK = re.compile(rf"(?<=[.!?])[{_SPACE}]+")
#: Bytes of words, and zero, stay; with ``marked`` all bytes beyond ASCII are letters' or digits'.
_WORD_BYTES = bytes(c if c in b"\0_" or c > 127 or chr(c).isalnum() else 32 for c in range(256))
_STOP = pa.array(L.STOP_OVERLAP)
#: Aliases, and keys of facts with a number each, that are broadcast, at most.
BROADCAST_ALIASES, BROADCAST_FACTS = 100_000, 1_000_000


def shared_words(asked: DataFrame, facts: DataFrame, k: int, often: int = OFTEN) -> DataFrame:
    """id, fact, score (shared distinct words), rank: the ``k`` best facts of each id; ties to the smaller fact.

    ``asked``: id, words (array); ``facts``: fact, words. Ids and facts that share a word meet by that word, so the
    join has ``often`` rows at most for each word of a fact (or of an id), but for frequent words, which are in more
    than ``often`` of both. With any of these:

    1. Other words are joined as before, and each frequent word with its ``k`` smallest facts. These pairs are
       scored exactly (frequent words by intersecting arrays), so a k-th best score is known: the bar.
    2. Any other fact shares frequent words alone, so it is found once for each distinct set of frequent words and
       not for each id: a fact under the bar cannot count, and one that reaches it has one of the set's rarest
       |set| - bar + 1 words. The ``k`` best facts of a set are enough, since they outrank all others for each id.
    """
    words = lambda df, key: df.select(key, F.explode(F.array_distinct("words")).alias("w"))
    best = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), "fact")
    # facts are dealt by key: a task counts the pairs of its own facts alone, and of few
    a, f = words(asked, "id"), words(spread(facts, "fact"), "fact")
    common = stored(a.groupBy("w").count().where(F.col("count") > often).select("w"), "frequent-asked")
    counts = None if common.isEmpty() else stored(f.join(common, "w").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > often), "frequent-both")
    if counts is None or counts.isEmpty():
        pairs = a.join(f, "w").groupBy("id", "fact").agg(F.count("*").alias("score"))
        return pairs.withColumn("rank", F.row_number().over(best("id"))).where(F.col("rank") <= k)
    f = stored(f.join(a.select("w").distinct(), "w", "left_semi"), "postings")
    few, many = a.join(counts, "w", "left_anti"), a.join(counts, "w")
    hot = f.join(counts.select("w"), "w")
    sets = many.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("set"))
    of_fact = hot.groupBy("fact").agg(F.collect_list("w").alias("hot"))
    pairs = few.join(f, "w").groupBy("id", "fact").agg(F.count("*").alias("r"))
    pairs, sets, of_fact = stored(pairs, "rare-pairs"), stored(sets, "word-sets"), stored(of_fact, "frequent-words")
    heads = hot.withColumn("at", F.row_number().over(Window.partitionBy("w").orderBy("fact"))).where(F.col("at") <= k).select("w", "fact")
    first = pairs.unionByName(many.join(heads, "w").select("id", "fact", F.lit(0).cast("long").alias("r"))).groupBy("id", "fact").agg(F.max("r").alias("r"))
    both = F.coalesce(F.size(F.array_intersect("set", "hot")), F.lit(0))
    scored = stored(first.join(sets, "id", "left").join(of_fact, "fact", "left").select("id", "fact", (F.col("r") + F.when(F.col("set").isNull() | F.col("hot").isNull(), 0).otherwise(both)).alias("score")), "scored-pairs")
    bar = scored.withColumn("rank", F.row_number().over(best("id"))).where(F.col("rank") == k).select("id", F.col("score").alias("bar"))
    open_sets = sets.join(bar, "id", "left").groupBy("set").agg(F.greatest(F.lit(1), F.min(F.coalesce("bar", F.lit(0)))).cast("int").alias("bar")).where(F.size("set") >= F.col("bar"))
    needed = F.slice("set", F.lit(1), F.size("set") - F.col("bar") + 1)
    near = open_sets.select("set", "bar", F.explode(needed).alias("w")).join(hot, "w").select("set", "bar", "fact").distinct()
    near = near.join(of_fact, "fact").select("set", "bar", "fact", both.cast("long").alias("score")).where(F.col("score") >= F.col("bar"))
    near = near.withColumn("rank", F.row_number().over(best("set"))).where(F.col("rank") <= k).select("set", "fact", F.col("score").alias("o"))
    more = sets.join(near, "set").select("id", "fact", "o").join(pairs, ["id", "fact"], "left").select("id", "fact", (F.col("o") + F.coalesce("r", F.lit(0))).alias("score"))
    return scored.unionByName(more).distinct().withColumn("rank", F.row_number().over(best("id"))).where(F.col("rank") <= k)


def lexical_retrieve(claims: DataFrame, facts: DataFrame, k: int = 3, often: int = OFTEN, prose: bool = False) -> DataFrame:
    """claim_id, fact_id, score (shared distinct words), rank; ``claims``: claim_id, text; ``facts``: fact_id, text.

    ``prose``: by ``shared_words_blocked``, with the same result.
    """
    split = (F.lower("text") if prose else F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("words")
    a, f = claims.select(F.col("claim_id").alias("id"), split), facts.select(F.col("fact_id").alias("fact"), split)
    found = shared_words_blocked(a, f, k) if prose else shared_words(a, f, k, often)
    return found.select(F.col("id").alias("claim_id"), F.col("fact").alias("fact_id"), "score", "rank")


def _inside(words: list[bytes], low: bytes) -> np.ndarray:
    """Which of the words, which have no ASCII white space, are in the text anywhere."""
    tokens = set(low.split())
    inside = np.array([w in tokens for w in words], dtype=bool)
    rest, text = np.flatnonzero(~inside), b" ".join(tokens) + b" " * 8
    if len(rest) > FEW_WORDS:
        # runs of 8 bytes as numbers, sorted: shorter words are compared by them, longer ones only sought if their ends are there
        run = np.zeros(len(text) - 7, dtype=np.uint64)
        for i in range(8):
            run |= np.frombuffer(text, np.uint8)[i : i + len(run)].astype(np.uint64) << np.uint64(56 - 8 * i)
        run.sort()
        size = np.array([min(len(words[j]), 8) for j in rest])
        inside[rest[size == 0]] = True
        for n in np.unique(size[size > 0]):
            own, there = rest[size == n], run >> np.uint64(64 - 8 * int(n))
            has = lambda values, there=there: there[np.minimum(np.searchsorted(there, values), len(there) - 1)] == values
            of = lambda part, own=own: np.array([int.from_bytes(part(words[j]), "big") for j in own], dtype=np.uint64)
            inside[own] = has(of(lambda w: w[:8])) if n < 8 else has(of(lambda w: w[:8])) & has(of(lambda w: w[-8:]))
        rest = rest[inside[rest] & np.array([len(words[j]) > 8 for j in rest], dtype=bool)]
    for j in rest:
        inside[j] = words[j] in text
    return inside


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each list has, and the words."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten()


def _sentence_words(low: str, marked: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The words that ``T.overlap_words(T.sentences(text, "mark", 15))`` has: how many each sentence, of each its sentence and number, and all of them.

    ``low``: the text in lower case; ``marked``: this with a comma for all but letters and digits, white space and the ends of lines and
    sentences, if it is not plain ASCII; ``text``: the text, if it has another length.
    """
    parts = _AFTER_MARK.split((low if marked is None else marked).replace("\0", ","))
    written = parts if text is None else _AFTER_MARK.split(text)
    kept = "\0".join([s for s, w in zip(parts, written, strict=True) if _stripped_size(w) > 15])
    for c in _LINE_ENDS if marked is not None else "":
        kept = kept.replace(c, ",")
    n, words = _flat(pc.ascii_split_whitespace(pa.array(kept.encode().translate(_WORD_BYTES).split(b"\0"), pa.binary()).cast(pa.string())))
    some = pc.and_(pc.greater(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=_STOP)))
    words, of = words.filter(some).dictionary_encode(), np.repeat(np.arange(len(n)), n)[some.to_numpy(zero_copy_only=False)]
    pairs = distinct(of << 32 | words.indices.to_numpy())
    return np.bincount(pairs >> 32, minlength=len(n)), pairs >> 32, pairs & 0xFFFFFFFF, words.dictionary


def _stripped_size(s: str) -> int:
    """Characters without white space at both ends, as Java's ``$`` has it: also before a last line end that is no white space there."""
    s = s.strip(_SPACE)
    return len(s) if s[-1:] not in _LINE_ENDS else len(s[:-1].rstrip(_SPACE)) + len(s[-1:])


def _best_overlap(cw: pa.Array, low: str, marked: str | None, text: str | None) -> np.ndarray:
    """The largest share of words that each claim (its distinct words as a text) has in common with a sentence of the text."""
    n_c, words = _flat(pc.ascii_split_whitespace(cw))
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(n_c)), n_c)[some]
    coded, n_c = words.filter(pa.array(some)).dictionary_encode(), np.bincount(own, minlength=len(n_c))
    n_s, of, code, there = _sentence_words(low, marked, text)
    code = pc.fill_null(pc.index_in(there, value_set=coded.dictionary), -1).to_numpy().astype(np.int64)[code]
    code, of = code[code >= 0], of[code >= 0]
    of = of[np.argsort(code, kind="stable")]
    n_met = np.bincount(code, minlength=len(coded.dictionary))
    word = coded.indices.to_numpy().astype(np.int64)
    size, start = n_met[word], (np.cumsum(n_met) - n_met)[word]
    best = np.zeros(len(n_c))
    for at, to in runs(np.bincount(own, weights=size, minlength=len(n_c)).astype(np.int64), ENTRIES):
        a, b = np.searchsorted(own, (at, to))
        key = np.sort(np.repeat(own[a:b] << 32, size[a:b]) | of[ranges(start[a:b], size[a:b])])
        if len(key):
            first = np.flatnonzero(np.diff(key, prepend=-1))
            shared, c, s = np.diff(first, append=len(key)), key[first] >> 32, key[first] & 0xFFFFFFFF
            of_claim = np.flatnonzero(np.diff(c, prepend=-1))
            best[c[of_claim]] = np.maximum.reduceat(shared / (n_s[s] + n_c[c] - shared), of_claim)
    return best


def _supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, cw, lw = batch.column("claims")[i].values.flatten()
            n, words = _flat(pc.list_slice(pc.split_pattern(lw, " "), 1))
            coded = words.dictionary_encode()
            low, marked, text = (batch.column(name)[i].as_py() for name in ("low", "marked", "text"))
            inside = _inside(coded.dictionary.cast(pa.binary()).to_pylist(), low.encode())
            hits = np.bincount(np.repeat(np.arange(len(n)), n), weights=inside[coded.indices.to_numpy()], minlength=len(n))
            yield pa.RecordBatch.from_pydict({"claim_id": ids, "best": pa.array(_best_overlap(cw, low, marked, text)), "match": pa.array(hits / np.maximum(n, 1))})


def document_support(found: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_id, best, match: over a claim's documents, the most that its words overlap with a sentence's, and ``rules.word_match``.

    ``found``: claim_id, fact_id; ``claims``: claim_id, text; ``docs``: fact_id, text. A document meets its claims in
    groups of ``CLAIMS_AT_ONCE``, so its words are looked up and its sentences cut once a group, and one that many claims found is
    dealt to many tasks.
    """
    many = stored(found.groupBy("fact_id").agg(F.ceil(F.count("*") / CLAIMS_AT_ONCE).alias("n")), "found-facts")
    total = many.agg(F.count("*").alias("facts"), F.sum("n").alias("groups")).first()
    n = max(docs.sparkSession.sparkContext.defaultParallelism * 2, (total.groups or 0) // DOCUMENTS_AT_ONCE)
    # words as one text each, which has far less bytes than an array; the first of the long ones stands for none
    said = claims.select("claim_id", F.concat_ws(" ", T.overlap_words(F.col("text"))).alias("cw"), F.concat_ws(" ", F.lit("-"), R.long_words(F.col("text"))).alias("lw"))
    part = F.pmod(F.xxhash64("claim_id"), F.col("n")).alias("part")
    groups = found.join(many, "fact_id").select("fact_id", "claim_id", part).join(said, "claim_id").repartition(n, "fact_id", "part").groupBy("fact_id", "part").agg(F.collect_list(F.struct("claim_id", "cw", "lw")).alias("claims"))
    # a text goes once to each of its groups, and one that no claim found goes nowhere
    texts = docs.join(F.broadcast(many) if total.facts <= BROADCAST_FACTS else many, "fact_id")
    texts = texts.select("fact_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), F.coalesce("text", F.lit("")).alias("text")).repartition(n, "fact_id", "part")
    low = F.lower("text")
    marked = F.when(F.octet_length(low) > F.length(low), F.regexp_replace(low, rf"[^\p{{L}}\p{{N}}_.!?\s{_LINE_ENDS}]", ",")).alias("marked")
    rows = groups.join(texts, ["fact_id", "part"]).select(low.alias("low"), marked, F.when(F.length(low) != F.length("text"), F.col("text")).alias("text"), "claims")
    return rows.mapInArrow(_supported, "claim_id string, best double, match double").groupBy("claim_id").agg(F.max("best").alias("best"), F.max("match").alias("match"))


def dense_retrieve(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank: exact inner products of a stated query set against all rows.

    ``queries``: query_id, q; ``corpus``: vec_id, v. A query does not find itself.
    """
    of = lambda df, key, v: df.where(F.col(v).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(v).cast("array<double>").alias("vector"))
    return nearest(of(queries, "query_id", "q"), of(corpus, "vec_id", "v"), k)


def alias_join(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (id, name) with title: the canonical title of the normalised name, else the name."""
    a = aliases.select(T.normalized(F.col("alias")).alias("key"), "title").groupBy("key").agg(F.min("title").alias("title"))
    a = F.broadcast(a) if aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES else a
    return names.withColumn("key", T.normalized(F.col("name"))).join(a, "key", "left").withColumn("title", F.coalesce("title", "name")).drop("key")


Provider = Callable[[DataFrame, int], DataFrame]


def provider_merge(claims: DataFrame, providers: list[Provider], k: int) -> DataFrame:
    """Evidence of the providers in their order, until a claim has ``k``: claim_id, provider, pos, text, score."""
    out = None
    for i, f in enumerate(providers):
        part = f(claims, k).withColumn("provider", F.lit(i))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("claim_id").orderBy("provider", "pos")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def evidence_fallback(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, response_id, pos) with source_claim: their own id if they have evidence, else the first of their response that has."""
    has = evidence.select("claim_id").distinct().withColumn("has", F.lit(True))
    w = Window.partitionBy("response_id").orderBy("pos", "claim_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = claims.join(has, "claim_id", "left")
    first = F.first(F.when(F.col("has"), F.col("claim_id")), ignorenulls=True).over(w)
    return j.select("claim_id", "response_id", F.when(F.col("has"), F.col("claim_id")).otherwise(first).alias("source_claim"))


def pair_graph(evidence: DataFrame, per_item: int = 3, longer_than: int = 15) -> DataFrame:
    """Edges between sentences of a claim's evidence (claim_id, pos, text): src, dst, relation, weight."""
    nodes = evidence.select("claim_id", "pos", F.posexplode(F.slice(T.sentences(F.col("text"), "mark", longer_than), 1, per_item)).alias("i", "s"))
    nodes = nodes.select("claim_id", (F.col("pos") * per_item + F.col("i")).alias("node"), T.overlap_words(F.col("s")).alias("w"), T.matches(F.col("s"), r"\b(not|no|never)\b").alias("neg"))
    a, b = nodes.alias("a"), nodes.alias("b")
    j = a.join(b, (F.col("a.claim_id") == F.col("b.claim_id")) & (F.col("a.node") < F.col("b.node")))
    sim = T.jaccard(F.col("a.w"), F.col("b.w"))
    differ = F.col("a.neg") != F.col("b.neg")
    rel = F.when(F.col("sim") > 0.70, "redundant").when((F.col("sim") > 0.30) & F.col("differ"), "contradict").when(F.col("sim") > 0.30, "support")
    e = j.select(F.col("a.claim_id").alias("claim_id"), F.col("a.node").alias("src"), F.col("b.node").alias("dst"), sim.alias("sim"), differ.alias("differ")).withColumn("relation", rel).where("relation IS NOT NULL")
    weight = F.when(F.col("relation") == "redundant", 0.90).when(F.col("relation") == "contradict", -0.85).otherwise(0.80)
    return e.select("claim_id", "src", "dst", "relation", weight.alias("weight"))


def graph_consensus(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """consensus of each claim: pos / (pos + |neg|); 0.5 without evidence, 0.75 without edges."""
    pos, neg = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)), F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0))
    g = edges.groupBy("claim_id").agg((pos / (pos + neg)).alias("v"))
    some = nodes.select("claim_id").distinct().withColumn("some", F.lit(True))
    return claims.select("claim_id").join(some, "claim_id", "left").join(g, "claim_id", "left").select("claim_id", F.coalesce("v", F.when(F.col("some"), 0.75).otherwise(0.5)).alias("consensus"))


def rank_sentences(pairs: DataFrame, top_n: int = 2) -> DataFrame:
    """id, rank, sentence, score: the best sentences of ``passage`` for ``claim`` (columns id, claim, passage).

    Word overlap, 0.35 more for a shared predicate, 1 at most; a passage without sentences gives its first 200 characters at 0.5.
    """
    s = pairs.withColumn("ss", T.sentences(F.col("passage"), "mark", 15))
    short = F.array(F.substring("passage", 1, 200))
    e = s.select("id", "claim", (F.size("ss") == 0).alias("bare"), F.posexplode(F.when(F.size("ss") == 0, short).otherwise(F.col("ss"))).alias("pos", "sentence"))
    has = lambda c: F.filter(F.array(*map(F.lit, L.PREDICATES)), lambda p: F.lower(c).contains(p))
    boost = F.when((F.size(has(F.col("claim"))) > 0) & F.exists(has(F.col("claim")), lambda p: F.lower(F.col("sentence")).contains(p)), 0.35).otherwise(0.0)
    score = F.when(F.col("bare"), 0.5).otherwise(F.round(F.least(F.lit(1.0), T.word_overlap(F.col("claim"), F.col("sentence")) + boost), 4))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return e.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("id", "rank", "sentence", "score")


def _near_rounds(left: DataFrame, limit: float, keep: int) -> DataFrame:
    """``dedup_near`` of items (claim_id, x) for claims of any number of them.

    One round an item that stays: the best of what is left of each claim is taken (a minimum, made in part
    before the shuffle), and the claim's items that are too like it go.
    """
    out = None
    for n in range(1, keep + 1):
        left = stored(left, f"near-round-{n}")
        best = left.groupBy("claim_id").agg(F.min("x").alias("best"))
        part = best.select("claim_id", F.lit(n).alias("n"), "best.pos")
        out = part if out is None else out.unionByName(part)
        left = left.join(best, "claim_id").where(~_like(F.col("x"), F.col("best"), limit)).select("claim_id", "x")
    return out


def _like(a: Column, b: Column, limit: float) -> Column:
    return F.size(F.array_intersect(a["w"], b["w"])) / F.size(F.array_union(a["w"], b["w"])) >= limit


def dedup_near(evidence: DataFrame, limit: float = 0.85, keep: int = 3, together: int = TOGETHER) -> DataFrame:
    """claim_id, n, pos: per claim, by falling score: an item goes if it is too like one that stays; the first ``keep`` stay.

    A claim of ``together`` items at most is one array, folded in one pass; larger ones, if there are any, go by rounds.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    item = F.struct((-F.col("score")).alias("o"), F.col("pos").cast("int").alias("pos"), words.alias("w"))
    large = stored(evidence.groupBy("claim_id").count().where(F.col("count") > together).select(F.col("claim_id").alias("__large")), "claims-of-many-items")
    some = not large.isEmpty()
    is_large = F.col("claim_id").eqNullSafe(F.col("__large"))
    few = evidence.join(large, is_large, "left_anti") if some else evidence
    sorted_items = few.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    none = F.array().cast(sorted_items.schema["xs"].dataType)
    stays = F.aggregate("xs", none, lambda kept, x: F.when((F.size(kept) < keep) & F.forall(kept, lambda b: ~_like(x, b, limit)), F.concat(kept, F.array(x))).otherwise(kept))
    out = sorted_items.select("claim_id", F.posexplode(F.transform(stays, lambda x: x["pos"])).alias("n", "pos")).select("claim_id", (F.col("n") + 1).alias("n"), "pos")
    out = out.where("n = 1 OR claim_id IS NOT NULL")  # without a claim no item is compared
    if not some:
        return out
    return out.unionByName(_near_rounds(evidence.join(large, is_large, "left_semi").select("claim_id", item.alias("x")), limit, keep))


def filter_quality(evidence: DataFrame, least: float = 0.15, min_length: int = 20) -> DataFrame:
    """Evidence long and relevant enough, the first of each beginning; a claim that would lose all keeps its first."""
    rel = F.coalesce(F.col("score"), F.lit(0.5))
    good = (F.length("text") >= min_length) & (rel >= least)
    e = evidence.withColumn("good", good).withColumn("key", F.lower(F.substring("text", 1, 100)))
    first = F.row_number().over(Window.partitionBy("claim_id", "good", "key").orderBy("pos"))
    e = e.withColumn("stays", F.col("good") & (first == 1))
    some = F.max(F.col("stays").cast("int")).over(Window.partitionBy("claim_id"))
    at = F.row_number().over(Window.partitionBy("claim_id").orderBy("pos"))
    return e.withColumns({"some": some, "at": at}).where(F.col("stays") | ((F.col("some") == 0) & (F.col("at") == 1))).drop("good", "key", "stays", "some", "at")


def drop_disambiguation(evidence: DataFrame) -> DataFrame:
    """Without pages that only list meanings, unless a claim has nothing else."""
    flag = F.lower(F.coalesce("text", F.lit(""))).rlike("disambiguation|may refer to")
    other = F.max((~flag).cast("int")).over(Window.partitionBy("claim_id"))
    return evidence.withColumns({"__f": flag, "__o": other}).where(~F.col("__f") | (F.col("__o") == 0)).drop("__f", "__o")
