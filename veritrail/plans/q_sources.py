"""Queries of sources and sinks: given tables written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import readers as R
from ..sources import writers as W
from .registry import query, table
from .views import PRED, QA, predictions, qa_pairs



@query("S01_read_paired_jsonl", f"WITH {QA} SELECT md5(query) AS q, md5(r) AS r, l AS label, p AS provenance FROM (SELECT query, response AS r, false AS l, 'given' AS p FROM qa WHERE query <> '' AND response <> '' UNION ALL SELECT query, 'no ' || response, true, 'given' FROM qa WHERE query <> '')")
def s01(spark, d):
    path = scratch(spark, "paired")
    qa_pairs(spark, d).select(F.lit("").alias("question"), F.col("query").alias("knowledge"), F.col("response").alias("right_answer"), F.concat(F.lit("no "), "response").alias("hallucinated_answer"), F.lit("given").alias("derivation_method")).write.json(path)
    return R.read_paired(spark, path).select(F.md5("query").alias("q"), F.md5("response").alias("r"), "label", "provenance")


@query("S02_read_labeled_qa_jsonl", f"WITH {QA} SELECT md5(query) AS q, md5(response) AS r, length(response) % 2 = 0 AS label, 'triviaqa' AS provenance FROM qa")
def s02(spark, d):
    path = scratch(spark, "labeled")
    qa_pairs(spark, d).select(F.col("query").alias("question"), F.col("response").alias("model_response"), (F.length("response") % 2 == 0).alias("is_hallucination")).write.json(path)
    return R.read_labeled_qa(spark, path).select(F.md5("query").alias("q"), F.md5("response").alias("r"), "label", "provenance")


@query("S03_read_multilingual_jsonl", f"WITH {QA} SELECT md5(query) AS q, length(response) % 2 = 0 AS label, 'fr' AS language FROM qa")
def s03(spark, d):
    path = scratch(spark, "multilingual")
    qa_pairs(spark, d).select("query", "response", (F.length("response") % 2 == 0).alias("label")).write.json(path)
    return R.read_multilingual(spark, path, "fr").select(F.md5("query").alias("q"), "label", "language")


@query("S06_read_fact_jsonl", "SELECT md5(text) AS claim, 'SUPPORTS' AS label, source AS wiki_page FROM documents")
def s06(spark, d):
    path = scratch(spark, "facts")
    table(spark, d, "documents").select(F.col("text").alias("claim"), F.lit("SUPPORTS").alias("label"), F.col("text").alias("evidence_text"), F.col("source").alias("wiki_page")).write.json(path)
    return R.read_facts(spark, path).select(F.md5("claim").alias("claim"), "label", "wiki_page")


@query("S09_derive_qa_labels", "SELECT s_suppkey AS id, s_name AS response, false AS label FROM supplier UNION ALL SELECT s_suppkey, replace(['Atlantis', 'El Dorado', 'Supplier', 'Avalon'][s_suppkey % 4 + 1], 'Supplier', 'Unknown Entity 404'), true FROM supplier")
def s09(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Who?").alias("question"), F.col("s_name").alias("gold"))
    return R.derive_qa_labels(rows, ["Atlantis", "El Dorado", "Supplier", "Avalon"]).select("id", "response", "label")


_CACHE = "c AS (SELECT event_type AS key, value AS evidence, ts AS cached_at FROM events), m AS (SELECT max(ts) AS now FROM events)"


@query("S10_evidence_table_lookup", f"WITH {_CACHE}, v AS (SELECT key, arg_max(evidence, cached_at) AS evidence FROM c, m WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', cached_at)) <= 3600 GROUP BY key), q(id, query) AS (VALUES (1, ' Click'), (2, 'view '), (3, 'nothing'), (4, 'ERROR')) SELECT id, evidence, v.key IS NOT NULL AS hit FROM q LEFT JOIN v ON v.key = lower(trim(query))")
def s10(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    q = spark.createDataFrame([(1, " Click"), (2, "view "), (3, "nothing"), (4, "ERROR")], "id int, query string")
    return R.cached_evidence(q, e.select(F.col("event_type").alias("key"), F.col("value").alias("evidence"), F.col("ts").alias("cached_at")), now, 1.0).select("id", "evidence", "hit")


@query("S12_write_examples_jsonl", f"WITH {PRED} SELECT id, y AS label, source, lang FROM pred")
def s12(spark, d):
    path = scratch(spark, "examples")
    W.write_examples(predictions(spark, d).select(F.col("id").cast("string").alias("query"), F.lit("r").alias("response"), F.col("y").alias("label"), "source", F.col("lang").alias("language")), path)
    return spark.read.schema("query string, label int, source string, lang string").json(path).select(F.col("query").cast("long").alias("id"), "label", "source", "lang")


@query("S15_write_eval_report", f"WITH {PRED} SELECT * FROM (SELECT 'perf_n' AS metric, count(*)::DOUBLE AS value FROM pred UNION ALL SELECT 'perf_mean', avg(p) FROM pred)")
def s15(spark, d):
    path = scratch(spark, "report")
    W.report_rows(predictions(spark, d).agg(F.count("*").alias("n"), F.avg("p").alias("mean")), "perf_").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("metric string, value double").csv(path)


@query("S04_read_frozen_benchmark", f"WITH {QA} SELECT md5(query) AS q, md5(response) AS r, length(response) % 2 = 0 AS label FROM qa")
def s04(spark, d):
    path = scratch(spark, "frozen") + ".csv"
    label = F.when(F.length("response") % 2 == 0, " Hallucinated ").otherwise("no")
    qa_pairs(spark, d).select(F.lit("").alias("prompt"), "query", F.col("response").alias("generated_response"), label.alias("label")).write.option("header", True).option("escape", '"').csv(path)
    return R.read_frozen(spark, path).select(F.md5("query").alias("q"), F.md5("response").alias("r"), "label")


@query("S05_read_eval_csv", "SELECT p_partkey AS id, md5(p_name) AS prompt, (p_partkey % 2)::INT AS label, 64::BIGINT AS digest_length FROM part")
def s05(spark, d):
    path = scratch(spark, "eval") + ".csv"
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("").alias("prompt"), F.col("p_name").alias("query"), F.lit("x").alias("response"), (F.col("p_partkey") % 2).alias("label"))
    p.write.option("header", True).csv(path)
    return R.read_eval_csv(spark, path).select("id", F.md5("prompt").alias("prompt"), "label", F.length("sha256").cast("long").alias("digest_length")).distinct()


@query("S07_read_knowledge_dir", "SELECT md5(text) AS text, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Wiki Notes' END AS source FROM documents WHERE trim(text) <> ''")
def s07(spark, d):
    folder = scratch(spark, "knowledge")
    docs = table(spark, d, "documents").select("text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("source"))
    R.write_named_jsonl(docs, f"{folder}/wiki_notes.jsonl")
    R.write_named_jsonl(docs, f"{folder}/halueval.jsonl")
    return R.read_knowledge(spark, folder).select(F.md5("text").alias("text"), "source")


@query("S08_read_prompt_batch", "SELECT md5(p_name) AS prompt, 'csv' AS kind FROM part UNION ALL SELECT md5(n_name), 'list' FROM nation UNION ALL SELECT md5(r_name), 'object' FROM region")
def s08(spark, d):
    path = scratch(spark, "prompts")
    table(spark, d, "part").select(F.col("p_name").alias("prompt")).write.option("header", True).csv(f"{path}/a.csv")
    one = lambda c: F.to_json(F.collect_list(c))
    table(spark, d, "nation").agg(one("n_name").alias("value")).write.text(f"{path}/b")  # 25 names
    table(spark, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("query"))).alias("prompts"))).alias("value")).write.text(f"{path}/c")  # 5 names
    got = [R.read_prompts(spark, f"{path}/{p}").select(F.md5("prompt").alias("prompt"), F.lit(k).alias("kind")) for p, k in (("a.csv", "csv"), ("b", "list"), ("c", "object"))]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query("S11_evidence_ttl", f"WITH {_CACHE} SELECT key, count(*) AS n, count(*) FILTER (epoch(date_trunc('second', now)) - epoch(date_trunc('second', cached_at)) <= 86400) AS valid FROM c, m GROUP BY key")
def s11(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.count_if(R.still_valid(F.col("ts"), now, 24.0)).alias("valid"))


@query("S13_write_split_metadata", f"WITH {PRED}, s AS (SELECT source, CASE WHEN id % 2 = 0 THEN 'train' ELSE 'test' END AS split, y FROM pred) SELECT source, split, count(*) AS total, sum(y)::BIGINT AS positives, 'v1' AS version FROM s GROUP BY source, split")
def s13(spark, d):
    path = scratch(spark, "splits")
    W.write_split_metadata(predictions(spark, d).select("source", F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("y").alias("label")), path, "v1")
    return spark.read.schema("source string, split string, total long, positives long, version string").json(path)


@query("S14_write_results_claims", "SELECT o_custkey AS job_id, o_orderkey AS claim_id, o_orderpriority AS label, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_jobs FROM orders")
def s14(spark, d):
    path = scratch(spark, "results")
    o = table(spark, d, "orders")
    claims = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("claim_id"), F.array(F.struct(F.col("o_orderpriority").alias("label"))).alias("entities"))
    W.write_results(o.groupBy(F.col("o_custkey").alias("job_id")).agg(F.count("*").alias("n")), claims, path)
    jobs = spark.read.parquet(f"{path}/results").agg(F.countDistinct("job_id").alias("n_jobs"))
    back = spark.read.parquet(f"{path}/claims").select("job_id", "claim_id", F.get_json_object("entities", "$[0].label").alias("label"))
    return back.crossJoin(F.broadcast(jobs))  # one row


@query("S16_append_experiment_log", "SELECT event_type AS dataset, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def s16(spark, d):
    path = scratch(spark, "log")
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset"), "ts", F.lit(42).alias("seed"), "value")
    W.append_log(e.where("seed = 42 AND value >= 0"), path)
    W.append_log(e.where("NOT (seed = 42 AND value >= 0) OR value IS NULL"), path)
    return spark.read.parquet(path).groupBy("dataset", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
