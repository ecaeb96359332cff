"""Benchmark decontamination: windows of ten words of the test items against all windows of a corpus.

Test windows and corpus windows get the same 64-bit hashes, built by doubling (pairs from words, fours
from pairs, ...), so a window costs a few array passes whatever its length. Corpus windows are looked
up in the set of test hashes, which is broadcast if it has at most ``BROADCAST_WINDOWS`` windows and
item names, and joined by shuffle beyond. Hits are verified on the words themselves. DataFrame functions only.

Defined results: null and empty texts have no words; items without words have no windows; an item of
fewer than ten words is one window; a null item_id has no name, but its windows hit; equal windows of
several items count for each of them; rows equal in id and text give equal results; an empty table of
items leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import row_key, stored

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
#: Keys of contaminated documents are broadcast up to so many.
BROADCAST_KEYS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once: Catalyst would else repeat it wherever f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    """A-Z lower-cased ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; other letters stay as they are."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    blank = lambda w: F.when(w == "", 1).otherwise(0)
    ends = lambda p: F.slice(p, 1 + blank(F.element_at(p, 1)), F.greatest(F.lit(0), F.size(p) - blank(F.element_at(p, 1)) - blank(F.element_at(p, -1))))
    return _let(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ends)


def _tail(array: Column, start: int, shorter: int) -> Column:
    return F.slice(array, F.lit(start + 1), F.greatest(F.size(array) - shorter, F.lit(0)))


def _joined(a: Column, b: Column) -> Column:
    """Hashes of windows that follow each other, over the shorter of both."""
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _windows_of(words_col: Column, most: int, use) -> Column:
    """use(combine), where combine(m) has the hash of each window of ``m`` words (``most`` at most, 16 at most); built by doubling."""

    def combine(by_power: dict[int, Column], m: int) -> Column:
        powers = [p for p in (16, 8, 4, 2, 1) if m & p]
        out, at = by_power[powers[0]], powers[0]
        for p in powers[1:]:
            out, at = _joined(_tail(out, 0, p), _tail(by_power[p], at, at)), at + p
        return out

    def double(by_power: dict[int, Column], p: int) -> Column:
        if 2 * p > most:
            return use(lambda m: combine(by_power, m))
        h = by_power[p]
        return _let(_joined(_tail(h, 0, p), _tail(h, p, p)), lambda x: double(by_power | {2 * p: x}, 2 * p))

    return _let(F.transform(words_col, lambda w: F.xxhash64(w)), lambda h: double({1: h}, 1))


def window_hashes(words_col: Column, m: int) -> Column:
    """Hash of each window of ``m`` words (16 at most)."""
    return _windows_of(words_col, m, lambda combine: combine(m))


def windows_by_length(words_col: Column, lengths: list[int]) -> Column:
    """array<struct<length, at, hash>>: the windows of all ``lengths``, hashed in one go."""
    each = lambda combine, m: F.transform(combine(m), lambda h, i: F.struct(F.lit(m).alias("length"), i.alias("at"), h.alias("hash")))
    return _windows_of(words_col, max(lengths), lambda combine: F.concat(*[each(combine, m) for m in lengths]))


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """length, hash, gram, items: the distinct windows of ``items`` (item_id, text)."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("__words"))
    rows = rows.where(F.size("__words") > 0).withColumn("length", F.least(F.size("__words"), F.lit(width)))
    hashes = F.lit(None).cast("array<long>")
    for m in range(1, width + 1):
        hashes = F.when(F.col("length") == m, window_hashes(F.col("__words"), m)).otherwise(hashes)
    each = rows.select("item", "length", "__words", F.posexplode(hashes).alias("at", "hash"))
    gram = F.concat_ws(" ", F.expr("slice(__words, at + 1, length)"))
    return each.groupBy("length", "hash", gram.alias("gram")).agg(F.collect_set("item").alias("items"))


def _gram() -> Column:
    return F.concat_ws(" ", F.expr("slice(__words, at + 1, length)"))


def _in_one_pass(text: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """__key, length, at, items of the occurrences of a broadcast table's windows.

    The lookup and the comparison of words follow the explode in one stage, so a document's words are
    only looked at again where a hash hits, and nothing is shuffled.
    """
    each = text.select("__key", words(F.col("text")).alias("__words")).select("__key", "__words", F.inline(windows_by_length(F.col("__words"), lengths)))
    same = F.coalesce(_gram() == F.col("gram"), F.lit(False))  # not a join key, which would be built for every window
    return each.join(F.broadcast(table.select("length", "hash", "gram", "items")), ["length", "hash"]).where(same).select("__key", "length", "at", "items")


def _in_two_passes(text: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a table too large to broadcast: hashes are joined by shuffle, then the words of the hits compared."""
    each = text.select("__key", F.inline(windows_by_length(words(F.col("text")), lengths)))
    places = each.join(table.select("length", "hash").distinct(), ["length", "hash"]).groupBy("__key").agg(F.collect_set(F.struct("length", "at")).alias("places"))
    found = text.join(places, "__key").select("__key", "places", words(F.col("text")).alias("__words")).select("__key", "__words", F.inline("places"))
    return found.select("__key", "length", "at", _gram().alias("gram")).join(table.select("length", "gram", "items"), ["length", "gram"]).select("__key", "length", "at", "items")


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """__key, n_hit, items: the documents (id ``doc_id``, ``text``) that hold a window of ``items``.

    __key is ``row_key`` of the document. n_hit counts words inside any occurrence.
    """
    table = stored(windows(items, width), "test-windows")
    stats = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("names"), F.collect_set("length").alias("lengths")).first()
    text = docs.select(row_key("doc_id", "text").alias("__key"), "text")
    if stats["n"]:
        find = _in_one_pass if stats["n"] + stats["names"] <= BROADCAST_WINDOWS else _in_two_passes
        exact = find(text, table, sorted(stats["lengths"]))
    else:
        exact = text.select("__key", F.lit(0).alias("length"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("items")).where(F.lit(False))
    covered = F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(at, at + length - 1)"))))
    return exact.groupBy("__key").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of ``items``."""
    found = stored(hits(docs, items, width).select("__key"), "contaminated-keys")
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    return docs.withColumn("__key", row_key("doc_id", "text")).join(found, "__key", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = hits(docs, items)
    all_docs = docs.select("doc_id", row_key("doc_id", "text").alias("__key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return all_docs.join(found, "__key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CTEs over the views docs_in (doc_id, text) and benchmark; hit(doc_id, n_words, n_hit, items).
SQL_HITS = f"""
iw AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
ig AS (SELECT item, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram FROM iw, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS r(i) WHERE len(w) > 0),
g AS (SELECT m, gram, list(DISTINCT item) AS items FROM ig GROUP BY ALL),
dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM docs_in),
dg AS (SELECT doc_id, i, ms.m, array_to_string(w[i:i + ms.m - 1], ' ') AS gram FROM dw, (SELECT DISTINCT m FROM g) AS ms, unnest(range(1, len(w) - ms.m + 2)) AS r(i)),
hw AS (SELECT dg.doc_id, dg.i, dg.m, g.items FROM dg JOIN g USING (m, gram)),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hw, unnest(range(i, i + m)) AS r(p) GROUP BY doc_id),
hi AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hw, unnest(items) AS r(item) GROUP BY doc_id),
hit AS (SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hp.n_hit, 0)::BIGINT AS n_hit, coalesce(hi.items, []) AS items
        FROM dw LEFT JOIN hp USING (doc_id) LEFT JOIN hi USING (doc_id))"""
ORACLE = f"""
WITH docs_in AS (SELECT doc_id, text FROM documents),{SQL_HITS}
SELECT doc_id, n_words, n_hit, len(items)::BIGINT AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM hit
"""
