"""The corpus build as one plan: what happens to each document, its chunks and the build's counts; a document that fails stops no other.

Readers give errors as rows (``sources.pdf``, ``sources.registry``), so a damaged file is a row of its task. All tables are committed
as one version; a build that stops leaves the version before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import corpus
from sitelens.sources import pdf, registry, versions
from sitelens.staging import staged

EXTRACTED, FAILED, SKIPPED = "EXTRACTED", "FAILED", "SKIPPED_METADATA"
READABLE = (".pdf", ".docx")
CURATED_FILE = "rag_records.jsonl"
PAGES = ("document_id", "page", "text", "images", "drawings", "error")


def planned(documents: DataFrame) -> Column:
    """What is to happen to a document, by its relations, class and file, first rule first; ``EXTRACTED`` ones are to be read."""
    name, kind = F.substring_index("source_path", "/", -1), F.col("source_class")
    readable = F.lit(False)
    for suffix in READABLE:
        readable = readable | F.endswith(F.lower(name), F.lit(suffix))
    return (
        F.when(F.col("duplicate_of").isNotNull() & F.col("retrieval_eligible"), "DUPLICATE_SKIPPED")
        .when(kind.isin("ARCHIVE", "RESTRICTED", "GOVERNANCE"), F.concat(F.lit("SKIPPED_"), kind))
        .when((kind == "CURATED") & (name == CURATED_FILE), "CURATED_ATOMIC")
        .when((kind == "CURATED") | ~F.coalesce("retrieval_eligible", F.lit(False)) | ~F.coalesce(readable, F.lit(False)), SKIPPED)
        .otherwise(EXTRACTED)
    )


def read_pages(spark: SparkSession, root: str, documents: DataFrame) -> DataFrame:
    """``PAGES`` of the PDF and DOCX files under ``root``, named by ``documents(document_id, source_path)`` relative to it; a DOCX file is
    one page, its blocks in order."""
    base = root.split("://")[-1].rstrip("/") + "/"
    relative = lambda c: F.expr(f"substring({c}, locate({base!r}, {c}) + {len(base)})")
    pages = pdf.read_pdf(spark, root).select(relative("path").alias("source_path"), "page", "text", "images", "drawings", "error")
    blocks = registry.read_docx(spark, root)
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text"))))
    whole = blocks.groupBy("path").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("text"), F.max("error").alias("error"))
    none = F.lit(0)
    words = whole.select(relative("path").alias("source_path"), F.lit(1).alias("page"), "text", none.alias("images"), none.alias("drawings"), "error")
    return documents.select("document_id", "source_path").join(pages.union(words), "source_path").select(*PAGES)


def build(documents: DataFrame, pages: DataFrame) -> Mapping[str, DataFrame]:
    """``documents``, ``chunks``, ``no_text_pages`` and ``report`` of a build.

    ``documents(document_id, source_path, source_class, retrieval_eligible, duplicate_of)`` get ``extraction_status``,
    ``extraction_error``, ``page_count``, ``chunk_count`` and ``no_text_pages``. A document with an error on any page, or without a page, is
    FAILED and has no chunks.
    """
    state = documents.withColumn("_plan", planned(documents))
    wanted = state.where(F.col("_plan") == EXTRACTED).select("document_id")
    own = pages.join(wanted, "document_id", "left_semi")
    blank = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S"))
    facts = own.groupBy("document_id").agg(F.min("error").alias("_error"), F.count("*").alias("_pages"), F.array_sort(F.collect_list(F.when(blank, F.col("page")))).alias("_blank"))
    facts = staged(facts, "build-facts")
    sound = own.join(facts.where("_error is null").select("document_id"), "document_id", "left_semi").withColumn("id", F.struct("document_id", "page"))
    cut = corpus.chunks(sound, "id", "text").select("id.document_id", "id.page", "chunk_index", "chunk_text")
    cut = staged(cut.withColumn("chunk_id", corpus.chunk_id(F.col("document_id").cast("string"), F.col("page"), F.col("chunk_index"))), "build-chunks")
    counted = cut.groupBy("document_id").agg(F.count("*").alias("_chunks"))
    joined = state.join(facts, "document_id", "left").join(counted, "document_id", "left")
    read = F.col("_plan") == EXTRACTED
    error = F.when(read, F.coalesce("_error", F.when(F.col("_pages").isNull(), F.lit("no page could be read"))))
    done = joined.withColumn("extraction_error", error).withColumn("extraction_status", F.when(F.col("extraction_error").isNotNull(), FAILED).otherwise(F.col("_plan")))
    good = F.col("extraction_status") == EXTRACTED
    done = done.select(
        *documents.columns,
        "extraction_status",
        "extraction_error",
        F.when(good, F.col("_pages")).alias("page_count"),
        F.when(good, F.coalesce("_chunks", F.lit(0))).otherwise(0).alias("chunk_count"),
        F.when(good, F.col("_blank")).otherwise(F.array().cast("array<int>")).alias("no_text_pages"),
    )
    empty = sound.where(blank).select("document_id", "page", F.when((F.col("images") > 0) | (F.col("drawings") > 0), "VISUAL_CONTENT").otherwise("UNKNOWN").alias("assessment"))
    report = done.groupBy("extraction_status").agg(F.count("*").alias("documents"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), F.sum("chunk_count").alias("chunks"))
    return {"documents": done, "chunks": cut, "no_text_pages": empty, "report": report}


def build_corpus(spark: SparkSession, root: str, documents: DataFrame, target: str) -> int:
    """Reads the files under ``root``, builds and commits; the version."""
    pages = staged(read_pages(spark, root, documents), "build-pages")
    return versions.commit(spark, target, build(documents, pages) | {"pages": pages})
