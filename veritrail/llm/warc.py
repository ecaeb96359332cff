"""WARC archives with an index written first, read back by coalesced byte ranges.

Writing: every page becomes one gzip member (a WARC 1.1 record). Payloads of ``LEAST_BYTES`` or more
that are equal are stored once: the record of the smallest page_id is the response, the others revisit
it. Each task writes one archive under the shared folder and returns the index rows of its records
(file, offset, length, url, digest, ...), which are stored as Parquet before anything is read back. A
task that runs again writes another file, and only the file that its returned rows name is read.

Reading: selected index rows are grouped by file and block of ``BLOCK_BYTES``; within a block, records
less than ``GAP_BYTES`` apart are fetched by one range read, in order of offset. Each record's payload
is checked against its digest.

Files are opened with ``pyarrow.fs`` by URI (local, HDFS, S3, ...), so the folder named in
spark.checkpoint.dir has to be one it knows.

Defined results: a null html is an empty payload; pages that share both page_id and payload are all
responses (none is earlier); a null page_id counts as the largest and is left out of the record; a
null url is left out of the record; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, stored

LEAST_BYTES = 100
BLOCK_BYTES = 4 << 20
GAP_BYTES = 64 << 10
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and refers_to (null for responses) of each page.

    Only digests that occur twice are joined back, so the right side holds one small row for each
    group of copies; a hot digest is a skewed join, which adaptive execution splits.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = (
        base.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
        .where((F.col("n") > 1) & F.col("first_page").isNotNull()).select("digest", "first_page")
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_page"))
    return base.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", F.when(later, F.col("first_page")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = f"{page_id}:{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write archives under ``folder`` and return the stored index; ``records`` as of plan_records."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        out, file, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        file = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{file}", compression=None)
                    payload = r["payload"].encode()
                    member = _gzip(_record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"]))
                    out.write(member)
                    rows.append((file, at, len(member), r["page_id"], r["url"], r["digest"], len(payload), "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return stored(records.mapInArrow(task, INDEX), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def ranges(spans: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) spans as reads: (begin, end, spans in it)."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, n in sorted(spans):
        if out and at - out[-1][1] <= gap:
            begin, end, inside = out[-1]
            inside.append((at, n))
            out[-1] = (begin, max(end, at + n), inside)
        else:
            out.append((at, at + n, [(at, n)]))
    return out


def parse(member: bytes) -> tuple:
    """A row of READ from one gzip member; its payload is checked against the digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged record of page {fields.get('X-Page-ID')}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page"), payload if kind == "response" else None


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the selected ``index`` rows; a revisit has no payload of its own."""
    blocks = (
        index.select("file", F.floor(F.col("offset") / BLOCK_BYTES).alias("block"), F.struct("offset", "length").alias("span"))
        .groupBy("file", "block").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    )
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.to_pylist():
                with fs.open_input_file(f"{path}/{b['file']}") as f:
                    for begin, end, inside in ranges([(s["offset"], s["length"]) for s in b["spans"]]):
                        f.seek(begin)
                        got = f.read(end - begin)
                        rows = [parse(got[at - begin : at - begin + n]) for at, n in inside]
                        if not with_payload:
                            rows = [(*r[:-1], None) for r in rows]
                        for k in range(0, len(rows), 500):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500]), types)], names=names)

    return blocks.mapInArrow(task, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: archive every page, then read every record back."""
    folder = scratch(spark, "warc")
    index = write(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_page FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN q.page_id > m.first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN q.page_id > m.first_page THEN m.first_page END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)
"""
