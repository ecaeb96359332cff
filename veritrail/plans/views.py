"""Views over the given tables that the queries work on, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread
from .registry import table

#: Claims of a task.
TEMPLATED_ROWS = 20_000


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, p and p2 (two models' probabilities from text statistics), source, lang, error_type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    words = F.split(F.trim(F.col("text")), r"\s+")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), (F.size(F.array_distinct(words)) / F.size(words)).alias("p"),
        (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("p2"), "source", "lang", F.col("toxic").alias("toxic"),
    )


PRED = r"""pred AS (SELECT d.doc_id AS id, l.quality AS y,
  len(list_distinct(string_split_regex(trim(d.text), '\s+')))::DOUBLE / len(string_split_regex(trim(d.text), '\s+')) AS p,
  d.n_chars::DOUBLE / (d.n_chars + 2000) AS p2, d.source, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response_id, query, response: a user turn and the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "response": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), F.col("text").alias("query"), "response")


QA = """qa AS (SELECT conv_id || '-' || turn AS response_id, text AS query, response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def templated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, k, kind, truth, text, fact: sentences about suppliers and orders; every third differs from its fact."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    other = F.broadcast(nation.select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("o_name")))
    s = s.join(other, F.col("o") == (F.col("s_nationkey") + 1) % 25)
    place = lambda who, where: F.concat(who, F.lit(" is located in "), where, F.lit("."))
    sup = s.select(
        F.concat(F.lit("S"), "k").alias("claim_id"), F.col("k"), F.lit("location").alias("kind"), (F.col("k") % 3 != 0).alias("truth"),
        place(F.col("s_name"), F.when(F.col("k") % 3 == 0, F.col("o_name")).otherwise(F.col("n_name"))).alias("text"), place(F.col("s_name"), F.col("n_name")).alias("fact"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("yr"))
    made = lambda y: F.concat(F.lit("Order "), "k", F.lit(" was created in "), y, F.lit("."))
    orders = o.select(
        F.concat(F.lit("O"), "k").alias("claim_id"), F.col("k"), F.lit("temporal").alias("kind"), (F.col("k") % 3 != 0).alias("truth"),
        made(F.when(F.col("k") % 3 == 0, F.col("yr") + 1).otherwise(F.col("yr"))).alias("text"), made(F.col("yr")).alias("fact"),
    )
    # dealt by claim: what is grouped or joined by it is not shuffled again, and tasks don't grow with the tables
    return spread(sup.unionByName(orders), "claim_id", TEMPLATED_ROWS)


def templated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims (claim_id, response_id, pos, text, kind, truth) and evidence (claim_id, pos, text, source, score).

    Every third claim is changed so that the evidence of its key contradicts it. Evidence has the unchanged
    sentence and a record.
    """
    rows = templated_rows(spark, sf_dir)
    claims = rows.select("claim_id", F.concat(F.col("kind"), F.lit("-"), F.floor(F.col("k") / 4)).alias("response_id"), (F.col("k") % 4).cast("int").alias("pos"), "text", "kind", "truth")
    item = lambda pos, text, source, score: F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.lit(source).alias("source"), score.alias("score"))
    noise = F.concat(F.lit("Record "), "k", F.lit(" lists a warehouse and a carrier."))
    items = F.array(item(0, F.col("fact"), "Wikipedia", F.lit(0.9)), item(1, noise, "FEVER", (F.col("k") % 10) / 10.0))
    evidence = rows.where("k % 7 <> 0").select("claim_id", F.explode(items).alias("e")).select("claim_id", "e.*")
    return claims, evidence


TEMPLATED = """trows AS (
  SELECT 'S' || s_suppkey AS claim_id, s_suppkey AS k, 'location' AS kind, s_suppkey % 3 <> 0 AS truth,
    s_name || ' is located in ' || CASE WHEN s_suppkey % 3 = 0 THEN o.n_name ELSE n.n_name END || '.' AS text, s_name || ' is located in ' || n.n_name || '.' AS fact
  FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN nation o ON o.n_nationkey = (s_nationkey + 1) % 25
  UNION ALL
  SELECT 'O' || o_orderkey, o_orderkey, 'temporal', o_orderkey % 3 <> 0,
    'Order ' || o_orderkey || ' was created in ' || (year(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) || '.', 'Order ' || o_orderkey || ' was created in ' || year(o_orderdate) || '.'
  FROM orders),
claims AS (SELECT claim_id, kind || '-' || (k // 4) AS response_id, (k % 4)::INT AS pos, text, kind, truth FROM trows),
evidence AS (
  SELECT claim_id, 0 AS pos, fact AS text, 'Wikipedia' AS source, 0.9::DOUBLE AS score FROM trows WHERE k % 7 <> 0
  UNION ALL SELECT claim_id, 1, 'Record ' || k || ' lists a warehouse and a carrier.', 'FEVER', (k % 10) / 10.0::DOUBLE FROM trows WHERE k % 7 <> 0)"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, stage, ts, status, latency_ms, event_id."""
    return as_stages(table(spark, sf_dir, "events"))


def as_stages(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("value").alias("latency_ms"), "event_id")


STAGES = """stage_events AS (SELECT user_id AS job_id, event_type AS stage, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, value AS latency_ms, event_id FROM events)"""
