"""Sharding by extendible hashing: a directory of hash prefixes in which only buckets that exceed the
byte limit are split on one more bit.

A row's key is the first ``BITS`` bits of the md5 of its id and text. Bytes are summed by key prefix
at one fine depth (a few bits more than the limit calls for), and from those cells for every coarser
prefix. A bucket is a prefix that fits the limit while its parent does not. Cells that still exceed
the limit at the fine depth go round again, alone, with more bits. The directory (prefix, depth,
bytes) is small: about as many rows as shards.

Defined results: a null text has 0 bytes, a null id counts as an empty string; a row larger than the
limit is a shard of its own, marked ``oversize``; rows equal in id and text cannot be told apart by
any bit, and are marked so too if together they exceed the limit. An empty table has no shards. Other
columns pass through; clashing names (shard, depth, n_bytes, shard_bytes, oversize) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

BITS = 60
SHARD_BYTES = 1 << 20
#: Bits beyond those that equal shards would need, and bits more in each further round.
SPARE_BITS, MORE_BITS = 6, 10
BROADCAST_SHARDS = 1_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumns(
        {"__h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), "n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")}
    )


def directory(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """depth, prefix (the first ``depth`` bits as a number), bytes, oversize: one row for each shard."""
    keyed = _keyed(docs, id_col, text_col)
    large = keyed.where(F.col("n_bytes") > limit).groupBy(F.lit(BITS).alias("depth"), F.col("__h").alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
    rest = keyed.where(F.col("n_bytes") <= limit).select("__h", "n_bytes")
    total = rest.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits = min(BITS, SPARE_BITS + max(0, math.ceil(math.log2(max(1, total / limit)))))
    found, low, pending = [large.withColumn("oversize", F.lit(True))], 0, None
    while True:
        cells = rest.groupBy(F.shiftright("__h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        if pending is not None:
            cells = cells.join(pending, F.shiftright("cell", bits - low) == F.col("open"), "left_semi")
        depth = F.explode(F.sequence(F.lit(low), F.lit(bits)))
        sums = cells.select("cell", "bytes", depth.alias("depth")).groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = stored(sums, "shard-sums")
        fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        below = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        leaves = fits.join(below, ["depth", "prefix"], "left_anti")
        found.append(leaves.withColumn("oversize", F.col("bytes") > limit))
        pending = sums.where((F.col("depth") == bits) & (F.col("bytes") > limit)).select(F.col("prefix").alias("open"))
        if bits == BITS or pending.isEmpty():
            break
        low, bits = bits, min(BITS, bits + MORE_BITS)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return stored(out.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.max("oversize").alias("oversize")), "shard-directory")


def assign(docs: DataFrame, shards: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, shard (its bits as text), depth, shard_bytes and oversize.

    A row meets its shard by an equi-join on its prefix, once for each depth that the directory has
    (a few; ``BITS`` at most). Prefixes are unique, so no row is doubled, and one of the joins hits. A
    directory of at most ``BROADCAST_SHARDS`` rows is broadcast; a larger one is joined by shuffle.
    """
    seen = {r.depth: r.n for r in shards.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    out = _keyed(docs.drop("shard", "depth", "shard_bytes", "oversize"), id_col, text_col)
    found = F.lit(None).cast("struct<depth:int,prefix:bigint,bytes:bigint,oversize:boolean>")
    for depth in sorted(seen, reverse=True):  # a row that shares its whole hash with a larger one still goes to its own, lesser depth
        side = shards.where(F.col("depth") == depth).select(
            F.col("prefix").alias("__p"), F.struct(F.col("depth").cast("int").alias("depth"), "prefix", "bytes", "oversize").alias(f"__s{depth}")
        )
        side = F.broadcast(side) if seen[depth] <= BROADCAST_SHARDS else side
        out = out.join(side, F.shiftright("__h", BITS - depth) == F.col("__p"), "left").drop("__p")
        fine = F.lit(True) if depth == BITS else F.col("n_bytes") <= limit
        found = F.when(F.col(f"__s{depth}").isNotNull() & fine, F.col(f"__s{depth}")).otherwise(found)
    out = out.withColumn("__s", found)
    out = out.withColumns({"depth": F.col("__s.depth"), "shard_bytes": F.col("__s.bytes"), "oversize": F.col("__s.oversize"), "shard": F.expr("lpad(bin(__s.prefix), __s.depth, '0')")})
    return out.drop("__h", "__s", *[f"__s{d}" for d in seen])


def query(spark: SparkSession, sf_dir: str, limit: int = SHARD_BYTES) -> DataFrame:
    """op2: every document's shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs, directory(docs, limit), limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversize")


ORACLE = f"""
WITH k AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT d AS depth, h >> ({BITS} - d)::INT AS prefix, sum(n_bytes)::BIGINT AS bytes
      FROM k, unnest(range(0, {BITS + 1})) AS r(d) WHERE n_bytes <= {SHARD_BYTES} GROUP BY ALL),
l AS (SELECT k.doc_id, k.n_bytes, k.h, min(s.depth) AS depth FROM k JOIN s ON s.prefix = (k.h >> ({BITS} - s.depth)::INT) AND (s.bytes <= {SHARD_BYTES} OR s.depth = {BITS})
      WHERE k.n_bytes <= {SHARD_BYTES} GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, l.depth::INT AS depth, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(s.prefix), l.depth::INT, '0') END AS shard, s.bytes AS shard_bytes, s.bytes > {SHARD_BYTES} AS oversize
FROM l JOIN s ON s.depth = l.depth AND s.prefix = (l.h >> ({BITS} - l.depth)::INT)
UNION ALL
SELECT doc_id, n_bytes, {BITS}, lpad(bin(h), {BITS}, '0'), sum(n_bytes) OVER (PARTITION BY h)::BIGINT, true FROM k WHERE n_bytes > {SHARD_BYTES}
"""
