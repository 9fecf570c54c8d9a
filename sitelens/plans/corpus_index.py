"""From a built corpus to a searchable index: admitted chunks, a digest of their content, index versions and plain searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import corpus, lexical
from sitelens.sources import versions


def index_records(spark: SparkSession, built: str, version: int | None = None) -> DataFrame:
    """``id, document_id, source_path, page, text`` of the chunks that may enter the index, one for each text: that of the least id."""
    documents = versions.read(spark, built, "documents", version)
    chunks = versions.read(spark, built, "chunks", version).join(documents.select("document_id", "source_path", "retrieval_eligible"), "document_id")
    good = corpus.admitted_chunks(chunks, documents).withColumn("text", F.trim("chunk_text"))
    first = good.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by(F.struct("chunk_id", "document_id", "source_path", "page", "text"), "chunk_id").alias("c"))
    return first.select(F.col("c.chunk_id").alias("id"), "c.document_id", "c.source_path", "c.page", "c.text")


def content_digest(records: DataFrame) -> str:
    """A digest of ids and texts that does not depend on their order; hashes are added up where they are, not gathered."""
    h = F.xxhash64("id", "text")
    sums = records.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return sums.select(F.sha2(F.concat_ws(":", "n", F.coalesce("x", F.lit(0)), F.coalesce("s", F.lit(0))), 256)).first()[0]


def index_corpus(spark: SparkSession, built: str, target: str, parts: int = 8) -> str:
    """Commits an index of a built corpus where there is none of its content yet; what state it was in before."""
    records = index_records(spark, built)
    digest = content_digest(records)
    state = lexical.index_state(spark, target, digest, 0, False)
    if state != "READY":
        lexical.write_index(lexical.build_index(records, "id", "text"), target, parts, digest=digest)
    return state


def search_index(spark: SparkSession, built: str, target: str, texts: Sequence[str], top: int = 10) -> DataFrame:
    """``qid, rank, id, score, source_path, page`` of the best chunks of each of a few query texts."""
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, query string")
    best = lexical.ranked(lexical.bm25(lexical.read_index(spark, target), queries), top)
    facts = index_records(spark, built).select("id", "source_path", "page")
    return best.join(facts, "id").select("qid", "rank", "id", "score", "source_path", "page").orderBy("qid", "rank")
