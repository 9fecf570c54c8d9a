"""WARC archives: write, read back and resolve revisits (operator 2).

Revisit resolution shuffles headers only (payload digest, size, page id): equal digests
pre-aggregate to their largest page id, and the result joins back to the pages as a small table of
originals. The hottest digests, at most ``HOT_KEYS`` of them by the pigeonhole bound, join as a
broadcast; the rest shuffle. Deduplicated archives are written by Spark's own text writer through
the cluster's file system, so a lost executor only repeats its files.

Defined results: a null payload is empty; rows with equal id and payload get the same verdict;
a null page id can only become the original of its payload if no other page has it, and then
``refers_to`` is null; null URLs are written as ``urn:sitelens:null``. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import scratch_path, stored

MIN_REVISIT_BYTES = 1000
#: A digest that holds over 1/HOT_KEYS of all records is broadcast; there are at most HOT_KEYS.
HOT_KEYS = 1000
#: Payload bytes of an archive file; a reader holds one file.
FILE_BYTES = 12 << 20
CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

FOUND = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, target_uri string, stored_bytes long, block_ok boolean"
)


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds digest, size, record type and original to ``(page_id, url, html)`` rows."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("urn:sitelens:null")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("size") >= min_bytes).select("digest", "size", "page_id")
    originals = stored(
        heads.groupBy("digest", "size")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .where("copies > 1"),
        "warc-originals",
    )
    total = originals.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    hot = originals.where(F.col("copies") > max(total // HOT_KEYS, 1000)).select(
        F.col("digest").alias("hot_digest"), F.col("original").alias("hot_original")
    )
    cold = originals.select(F.concat("digest", F.lit(":"), "size").alias("key"), "original")
    return (
        rows.join(F.broadcast(hot), (F.col("digest") == F.col("hot_digest")) & (F.col("size") >= min_bytes), "left")
        .withColumn(
            "key",
            F.when(F.col("hot_digest").isNull() & (F.col("size") >= min_bytes), F.concat("digest", F.lit(":"), "size")).otherwise(
                F.concat(F.lit("-"), F.xxhash64("page_id", "digest"))
            ),
        )
        .join(cold, "key", "left")
        .withColumn("original", F.coalesce("hot_original", "original"))
        .withColumn("revisit", F.coalesce(F.col("original") > F.coalesce(F.col("page_id"), F.lit(-(2**63)).cast("long")), F.lit(False)))
        .select("page_id", "url", "payload", "digest", "size", "revisit", F.when(F.col("revisit"), F.col("original")).alias("original"))
    )


def _record_id(page_id, digest):
    h = F.md5(F.concat(F.lit("sitelens-page:"), F.coalesce(page_id.cast("string"), digest)).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """One WARC record a row, as text without the two line ends that close it."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    refers = F.when(
        F.col("revisit"),
        F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", _record_id(F.col("original"), F.col("digest"))),
            line("X-Refers-To-Page", F.col("original").cast("string")),
        ),
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Writes deduplicated archives of ``(page_id, url, html)`` under ``path`` and returns it."""
    resolved = resolve_revisits(pages, min_bytes)
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first().n
    files = max(1, -(-int(total) // file_bytes))
    (
        records(resolved.repartition(files, F.xxhash64("page_id", "digest")))
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .text(path)
    )
    return path


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive's bytes; a broken record raises ValueError."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split(CRLF)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        heads = dict(x.split(": ", 1) for x in lines[1:])
        size = int(heads["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} is cut")
        yield heads, block
        at = end + 8 + size


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for packed in batch["content"]:
            found = []
            for heads, block in parse(gzip.decompress(packed)):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rsplit(b": ", 1)[1])
                digest, kind = heads["WARC-Payload-Digest"].removeprefix("sha1:"), heads["WARC-Type"]
                ok = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                page, refers = heads.get("X-Page-ID"), heads.get("X-Refers-To-Page")
                found.append(
                    (int(page) if page else None, size, digest, kind, int(refers) if refers else None, heads["WARC-Record-ID"], heads["WARC-Target-URI"], len(payload), ok)
                )
            out = pd.DataFrame(found, columns=[x.split()[0] for x in FOUND.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; payloads are hashed again (``block_ok``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_read, FOUND)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and returns what the archives hold."""
    return read_archives(spark, write_archives(pages, scratch_path(spark, "warc")))
