"""Invariants of a built corpus and of a curated package: one row for each violation, ``code, key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.operators.corpus import duplicates, violation, violations


def corpus_errors(
    documents: DataFrame, chunks: DataFrame, files: DataFrame, curated: DataFrame, flags: DataFrame, no_text: DataFrame, primary_quality: DataFrame
) -> DataFrame:
    """The eighteen conditions that a corpus must not meet.

    ``documents(document_id, source_path, sha256, source_class, authority_class, document_status, title, retrieval_eligible,
    duplicate_of, chunk_count, no_text_pages)``, ``chunks(chunk_id, document_id, page_start, page_end)``, ``files(source_path, sha256)``
    as they are now, ``curated(record_id, review_flags, retrieval_eligible)``, ``flags(flag_id, trust_treatment, matched_record_ids)``,
    ``no_text(document_id, page)`` and ``primary_quality(document_id)`` as reported.
    """
    path, kind = F.col("source_path"), F.col("source_class")
    eligible = documents.select("document_id", "source_path", "retrieval_eligible")
    placed = chunks.join(eligible, "document_id", "left")
    present = documents.join(files.select("source_path", F.col("sha256").alias("_now")), "source_path", "left")
    active = F.col("chunk_count") > 0

    cru = documents.where(F.contains(F.concat(F.lit("/"), F.lower("source_path"), F.lit("/")), F.lit("/cru/")))
    now, older = F.col("document_status") == "CURRENT", F.col("document_status").isin("PROPOSED", "HISTORICAL")
    mislabelled = cru.agg(F.bool_or(now & F.contains(F.lower("title"), F.lit("proposed"))).alias("proposed"), F.bool_or(older).alias("older")).where("proposed and older")
    mixed = cru.groupBy("document_id").agg(F.bool_or(now).alias("now"), F.bool_or(older).alias("older")).where("now and older").limit(1)

    hits = flags.select("flag_id", "trust_treatment", F.explode("matched_record_ids").alias("record_id"))
    flagged = hits.join(curated, "record_id", "left")
    seen = F.col("retrieval_eligible").isNotNull()
    expected = documents.select("document_id", F.explode("no_text_pages").alias("page"))
    page_gap = expected.join(no_text, ["document_id", "page"], "left_anti").union(no_text.join(expected, ["document_id", "page"], "left_anti").select("document_id", "page"))
    primary = documents.where(kind == "PRIMARY").select("document_id")
    reported = primary_quality.select("document_id")
    coverage = primary.join(reported, "document_id", "left_anti").union(reported.join(primary, "document_id", "left_anti"))
    return violations(
        violation(duplicates(chunks, "chunk_id").limit(1), "DUPLICATE_CHUNK_ID", F.lit("chunks")),
        violation(placed.where(F.col("source_path").isNull()), "CHUNK_WITHOUT_DOCUMENT", F.col("chunk_id")),
        violation(placed.where(~F.col("retrieval_eligible")), "EXCLUDED_DOCUMENT_HAS_CHUNK", path),
        violation(chunks.where("page_start > page_end"), "INVALID_PAGE_RANGE", F.col("chunk_id")),
        violation(present.where(F.col("_now").isNull()), "SOURCE_MISSING", path),
        violation(present.where(F.col("_now") != F.col("sha256")), "SOURCE_CHANGED", path),
        violation(documents.where(kind.isin(*K.EXCLUDED_CLASSES) & active), "EXCLUDED_CLASS_HAS_CHUNKS", path),
        violation(documents.where(kind.isin("ARCHIVE", "RESTRICTED") & F.col("retrieval_eligible")), "EXCLUDED_CLASS_ELIGIBLE", path),
        violation(documents.where((kind == "SUPPORTING_INDUSTRY") & (F.col("authority_class") == "PRIMARY")), "INDUSTRY_AS_PRIMARY", path),
        violation(documents.where(F.col("duplicate_of").isNotNull() & active), "DUPLICATE_HAS_CHUNKS", path),
        violation(mislabelled, "PROPOSED_LABELLED_CURRENT", F.lit("cru")),
        violation(mixed, "CURRENT_AND_PROPOSED_NOT_DISTINCT", F.lit("cru")),
        violation(curated.where((F.size("review_flags") > 0) & F.col("retrieval_eligible")), "FLAGGED_RECORD_ELIGIBLE", F.col("record_id")),
        violation(flags.where((F.col("trust_treatment") == "NOT_TRUSTED_UNMATCHED") & (F.size("matched_record_ids") > 0)), "UNMATCHED_FLAG_HAS_MATCHES", F.col("flag_id")),
        violation(flagged.where(~seen), "FLAG_WITHOUT_RECORD", F.col("record_id")),
        violation(flagged.where(seen & ((F.size("review_flags") == 0) | F.col("retrieval_eligible"))), "FLAGGED_RECORD_NOT_EXCLUDED", F.col("record_id")),
        violation(page_gap.limit(1), "NO_TEXT_REPORT_DIFFERS", F.lit("pages")),
        violation(coverage.limit(1), "PRIMARY_REPORT_DIFFERS", F.lit("documents")),
    )


def missing_fields(rows: DataFrame, json_col: str, required: tuple[str, ...]) -> Column:
    """The required keys that a row's JSON object does not have, sorted."""
    return F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))))


def package_errors(sources: DataFrame, records: DataFrame, flags: DataFrame) -> DataFrame:
    """Violations of a curated package. ``sources(source_id)``; ``records(row, body)`` and ``flags(row, body)`` hold JSON objects."""
    known = sources.select("source_id").distinct()
    at = lambda path: F.get_json_object("body", path)
    r = records.select("row", "body", at("$.id").alias("id"), at("$.quality.review_required").alias("review"), at("$.quality.evidence_level").alias("level"))
    cited = r.select("id", F.explode(F.from_json(at("$.sources"), "array<struct<source_id:string,source_tier:string>>")).alias("s")).select("id", "s.source_id", "s.source_tier")
    f = flags.select("row", "body", at("$.flag_id").alias("flag_id"), at("$.source_id").alias("source_id"))
    official = f.select("flag_id", F.explode(F.from_json(at("$.official_sources"), "array<string>")).alias("source_id"))
    return violations(
        violation(duplicates(sources, "source_id").limit(1), "DUPLICATE_SOURCE_ID", F.lit("sources")),
        violation(r.where(F.size(missing_fields(r, "body", K.REQUIRED_RECORD_FIELDS)) > 0), "RECORD_FIELDS_MISSING", F.col("row")),
        violation(r.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.explode(F.sequence(F.lit(2), "n"))), "DUPLICATE_RECORD_ID", F.col("id")),
        violation(r.where(at("$.title.en").isNull()), "TITLE_NOT_ENGLISH", F.col("id")),
        violation(r.where(at("$.content.en").isNull() | at("$.content.retrieval_text").isNull()), "CONTENT_INCOMPLETE", F.col("id")),
        violation(r.where((F.col("review") == "false") & ~F.col("level").eqNullSafe(F.lit("primary_official"))), "EVIDENCE_NOT_PRIMARY", F.col("id")),
        violation(cited.join(known, "source_id", "left_anti"), "UNKNOWN_SOURCE", F.col("id")),
        violation(cited.where(~F.col("source_tier").eqNullSafe(F.lit("primary"))), "CITES_NON_PRIMARY", F.col("id")),
        violation(f.where(F.size(missing_fields(f, "body", K.REQUIRED_FLAG_FIELDS)) > 0), "FLAG_FIELDS_MISSING", F.col("row")),
        violation(f.groupBy("flag_id").agg(F.count("*").alias("n")).where("n > 1").select("flag_id", F.explode(F.sequence(F.lit(2), "n"))), "DUPLICATE_FLAG_ID", F.col("flag_id")),
        violation(f.join(known, "source_id", "left_anti"), "FLAG_OF_UNKNOWN_SOURCE", F.col("flag_id")),
        violation(official.join(known, "source_id", "left_anti"), "UNKNOWN_OFFICIAL_SOURCE", F.col("flag_id")),
    )


def histograms(records: DataFrame, *fields: str) -> DataFrame:
    """``field, value, n`` of each field in one pass."""
    long = records.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def changed_sources(manifest: DataFrame, files: DataFrame, key: str = "source_path") -> DataFrame:
    """``key, state``: MATCH, CHANGED or MISSING for each manifest entry by its digest."""
    joined = manifest.select(key, F.col("sha256").alias("_want")).join(files.select(key, F.col("sha256").alias("_now")), key, "left")
    return joined.select(key, F.when(F.col("_now").isNull(), "MISSING").when(F.col("_now") == F.col("_want"), "MATCH").otherwise("CHANGED").alias("state"))


def require_unchanged(manifest: DataFrame, files: DataFrame, key: str = "source_path") -> DataFrame:
    """``files`` that the manifest lists; a file whose digest differs stops the job that reads it."""
    joined = files.join(manifest.select(key, F.col("sha256").alias("_want")), key)
    checked = F.when(F.col("sha256") == F.col("_want"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("digest differs from the manifest: "), F.col(key))))
    return joined.withColumn("sha256", checked).drop("_want")
