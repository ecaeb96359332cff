"""Readers of examples, benchmarks, facts and prompts. Examples have query, response, label, language, source, provenance.

Of several keys the first that is neither null nor empty counts. Lines that are not JSON are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = ["query", "response", "label", "language", "source", "provenance"]


def first_of(*cols: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cols])


def _json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)


def read_paired(spark: SparkSession, path: str, task: str = "qa") -> DataFrame:
    """Up to two examples of each line, the right answer (label false) and the hallucinated one (true)."""
    names = ["knowledge", "document", "dialogue_history", "question", "provenance", "derivation_method"]
    right = ["right_answer", "right_response", "right_summary"]
    wrong = ["hallucinated_answer", "hallucinated_response", "hallucinated_summary"]
    d = _json(spark, path, ", ".join(f"{n} string" for n in [*names, *right, *wrong]))
    know = first_of("knowledge", "document", "dialogue_history")
    ask = F.coalesce(F.when(F.col("question") != "", F.col("question")), know)
    prov = F.coalesce(first_of("provenance", "derivation_method"), F.lit(f"halueval_{task}_benchmark"))
    pair = F.array(F.struct(first_of(*right).alias("response"), F.lit(False).alias("label")), F.struct(first_of(*wrong).alias("response"), F.lit(True).alias("label")))
    e = d.select(ask.alias("query"), prov.alias("provenance"), F.explode(pair).alias("x")).where("query IS NOT NULL AND x.response IS NOT NULL")
    return e.select("query", "x.response", "x.label", F.lit("en").alias("language"), F.lit(f"halueval_{task}").alias("source"), "provenance")


def read_labeled_qa(spark: SparkSession, path: str) -> DataFrame:
    """S02."""
    d = _json(spark, path, "question string, model_response string, is_hallucination boolean, provenance string, derivation_method string, source_dataset string")
    prov = F.coalesce(first_of("provenance", "derivation_method"), F.lit("triviaqa"))
    return d.where("question IS NOT NULL AND model_response IS NOT NULL").select(
        F.col("question").alias("query"), F.col("model_response").alias("response"), F.col("is_hallucination").alias("label"), F.lit("en").alias("language"),
        F.coalesce(first_of("source_dataset"), F.lit("triviaqa")).alias("source"), prov.alias("provenance"),
    )


def read_multilingual(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Fr, bn or am."""
    if language not in ("fr", "bn", "am"):
        raise ValueError(f"language: {language!r}")
    d = _json(spark, path, "query string, response string, label boolean, provenance string")
    return d.select("query", "response", "label", F.lit(language).alias("language"), F.lit(f"multilingual_{language}").alias("source"), F.coalesce(first_of("provenance"), F.lit("multilingual")).alias("provenance"))


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSONL by suffix; a CSV label is true if it reads 1, true, yes or hallucinated."""
    if path.endswith(".csv"):
        d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        for c in ("prompt", "query", "generated_response", "response", "label"):
            d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("string"))
        label = F.lower(F.trim("label")).isin("1", "true", "yes", "hallucinated")
    else:
        d = _json(spark, path, "prompt string, query string, generated_response string, response string, label string")
        label = F.lower("label").isin("1", "true")
    return d.select(first_of("prompt", "query").alias("query"), first_of("generated_response", "response").alias("response"), F.coalesce(label, F.lit(False)).alias("label"))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Id (its ordinal where missing), prompt, response, label, and the file's SHA-256."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in ("id", "prompt", "query", "generated_response", "response"):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("string"))
    content = file_digests(spark, path).select("sha256")
    rows = d.withColumn("__n", F.monotonically_increasing_id())  # one file of a benchmark: the order of its lines
    return rows.select(F.coalesce(F.col("id").cast("long"), F.col("__n")).alias("id"), first_of("prompt", "query").alias("prompt"), first_of("generated_response", "response").alias("response"), F.col("label").cast("int").alias("label")).crossJoin(F.broadcast(content))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """S06."""
    return _json(spark, path, "claim string, label string, evidence_text string, wiki_page string").where("claim IS NOT NULL")


def read_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Text, source (the file's name as a title where missing), metadata, of all files but halueval.jsonl."""
    d = _json(spark, f"{folder}/*.jsonl", "text string, source string, metadata map<string,string>").withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.\d+)?\.jsonl$", 1))
    title = F.initcap(F.regexp_replace("stem", "[_-]", " "))
    return d.where("stem <> 'halueval' AND trim(text) <> ''").select("text", F.coalesce(first_of("source"), title).alias("source"), "metadata")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a JSON list (of strings or of objects) or {prompts: [...]}, or of a CSV (query, prompt or the first column)."""
    if path.endswith(".csv"):
        d = spark.read.option("header", True).csv(path)
        name = next((c for c in ("query", "prompt") if c in d.columns), d.columns[0])
        return d.select(F.col(name).alias("prompt"))
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.get_json_object("value", "$.prompts"), F.col("value"))
    items = F.from_json(listed, "array<string>")
    return whole.select(F.explode(items).alias("x")).select(F.coalesce(F.get_json_object("x", "$.query"), F.get_json_object("x", "$.prompt"), F.col("x")).alias("prompt"))


def derive_qa_labels(rows: DataFrame, distractors: list[str]) -> DataFrame:
    """Each (id, question, gold) twice: the gold answer, and distractor id % 10 (another name if it is in the gold)."""
    d = F.element_at(F.array(*map(F.lit, distractors)), (F.col("id") % len(distractors) + 1).cast("int"))
    wrong = F.when(F.contains(F.lower("gold"), F.lower(d)), "Unknown Entity 404").otherwise(d)
    pair = F.array(F.struct(F.col("gold").alias("response"), F.lit(False).alias("label")), F.struct(wrong.alias("response"), F.lit(True).alias("label")))
    return rows.where("question <> '' AND gold <> ''").select("id", F.col("question").alias("query"), F.explode(pair).alias("x")).select("id", "query", "x.response", "x.label")


def still_valid(cached_at: Column, now: Column, ttl_hours: float = 24.0) -> Column:
    """Whether an entry of the cache is ``ttl_hours`` old at most."""
    return F.unix_timestamp(now) - F.unix_timestamp(cached_at.cast("timestamp")) <= ttl_hours * 3600


def write_named_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in a folder of the given name, whose parts carry its stem: what ``read_knowledge`` tells sources by."""
    spark, stem = df.sparkSession, path.rsplit("/", 1)[-1].removesuffix(".jsonl")
    parent, parts = path.rsplit("/", 1)[0], f"{path}.parts"
    df.write.json(parts)
    fs = spark._jvm.org.apache.hadoop.fs.Path(parent).getFileSystem(spark._jsc.hadoopConfiguration())
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for n, status in enumerate(s for s in fs.listStatus(to(parts)) if s.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), to(f"{parent}/{stem}.jsonl" if n == 0 else f"{parent}/{stem}.{n}.jsonl"))
    fs.delete(to(parts), True)


def cached_evidence(queries: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 24.0) -> DataFrame:
    """``queries`` (id, query) with the newest evidence of their key that is still valid; hit tells misses from empty entries.

    ``cache``: key, evidence, cached_at.
    """
    valid = cache.where(still_valid(F.col("cached_at"), now, ttl_hours))
    newest = valid.groupBy("key").agg(F.max_by("evidence", "cached_at").alias("evidence"), F.lit(True).alias("hit"))
    return queries.withColumn("key", F.lower(F.trim("query"))).join(newest, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


#: Bytes of a file that Spark reads as one value, at most; longer ones are read in pieces of ``PIECE``.
WHOLE, PIECE = 64 << 20, 8 << 20


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """File, size, sha256. Long files are streamed through their tasks, so neither memory nor 2 GiB a value bounds them."""
    listed = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    small = listed.where(F.col("length") <= WHOLE).select(name, F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    long = listed.where(F.col("length") > WHOLE).select(name, F.col("length").alias("size"), "path")  # the content is not read here

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in batch.column("path").to_pylist():
                files, inside = pa.fs.FileSystem.from_uri(at if "://" in at else "file://" + unquote(at.removeprefix("file:")))
                sha = hashlib.sha256()
                with files.open_input_stream(inside) as stream:
                    while piece := stream.read(PIECE):
                        sha.update(piece)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("size"), pa.array(found, pa.string())], names=["file", "size", "sha256"])

    return small.unionByName(long.mapInArrow(digest, "file string, size long, sha256 string"))
