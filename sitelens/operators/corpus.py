"""Document corpus: path rules, relations, chunks, headings, flags, facts, reports, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import text as T
from sitelens.operators import containment


def chunks(pages: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """``id, chunk_index, start, chunk_text`` windows of each text, blank ones dropped."""
    own = pages.select(F.col(id_col).alias("id"), *keep, T.normalised(text_col).alias("_t")).where(F.length("_t") > 0)
    own = own.select("id", *keep, "_t", F.posexplode(T.window_starts(F.col("_t"))).alias("chunk_index", "start"))
    cut = F.trim(F.substring(F.col("_t"), F.col("start") + 1, F.lit(K.CHUNK_CHARS)))
    return own.select("id", *keep, "chunk_index", "start", cut.alias("chunk_text")).where(F.col("chunk_text") != "")


def chunk_id(document_id: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s-p%04d-%03d", document_id, page.cast("int"), index.cast("int"))


def forward_filled(blocks: DataFrame, by: str, order: str, heading: Column) -> DataFrame:
    """Adds ``heading``: the last heading at or before each block."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


#: Path rules are configuration; more than these are refused instead of being put into a plan.
MOST_RULES = 1000


def longest_prefix(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds the rule of the longest prefix of each path; without any its columns are null.

    ``rules(prefix, ...)`` is configuration: its rows become one expression, so the paths neither shuffle nor join.
    Rows of equal paths stay apart.
    """
    held = rules.limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} path rules")
    kinds = {f.name: f.dataType for f in rules.schema.fields}
    order = sorted(held, key=lambda r: (-len(r.prefix), r.prefix, str(r)))
    if order:
        made = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in rules.columns]) for r in order]
        rule = F.coalesce(*[F.when(F.startswith(F.col(path_col), F.lit(r.prefix)), m) for r, m in zip(order, made, strict=True)])
        return paths.select("*", rule.alias("_rule")).select(*paths.columns, "_rule.*")
    return paths.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in rules.columns])


def with_overrides(documents: DataFrame, overrides: DataFrame, key: str = "path") -> DataFrame:
    """Columns of an explicit per-path override beat those of the rule."""
    own = [c for c in overrides.columns if c != key]
    named = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in own])
    out = documents.join(F.broadcast(named), key, "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", c) if c in documents.columns else F.col(f"_o_{c}") for c in own}).drop(*[f"_o_{c}" for c in own])


def duplicate_relations(documents: DataFrame, id_col: str, digest: Column, excluded: Column, order_key: Column) -> DataFrame:
    """``id, canonical_id`` of documents with equal digests: the canonical one is not excluded and comes first.

    Digests pre-aggregate to their canonical document; hot digests meet it by a plain, splittable join.
    """
    own = documents.select(F.col(id_col).alias("id"), digest.alias("digest"), F.struct(excluded.alias("e"), order_key.alias("k"), F.col(id_col).alias("id")).alias("o"))
    best = own.groupBy("digest").agg(F.min("o").alias("o"), F.count("*").alias("copies")).where("copies > 1")
    joined = own.select("id", "digest").join(best, "digest").where(F.col("id") != F.col("o.id"))
    return joined.select("id", F.col("o.id").alias("canonical_id"), "copies")


def flag_matches(records: DataFrame, flags: DataFrame) -> DataFrame:
    """``flag_id, record_id`` where the flag's source is among the record's or its claim is in the text.

    The OR is split: an equi join on sources and a join on the claims' anchors, united and made distinct. ``records(record_id,
    source_ids, text)``, ``flags(flag_id, source_id, original_claim)``; both may be large.
    """
    by_source = records.select("record_id", F.explode("source_ids").alias("source_id")).join(flags.select("flag_id", "source_id"), "source_id").select("flag_id", "record_id")
    by_claim = containment.contained(records.select("record_id", "text"), flags.select("flag_id", "original_claim"))
    return by_source.unionByName(by_claim).distinct()


def flag_audit(flags: DataFrame, matches: DataFrame) -> DataFrame:
    """Every flag with its match count and how it is treated."""
    counted = matches.groupBy("flag_id").agg(F.count("*").alias("n_records"), F.min("record_id").alias("first_record"))
    hit = F.col("n_records") > 0
    return flags.select("flag_id").join(counted, "flag_id", "left").select(
        "flag_id",
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        "first_record",
        F.when(hit, "B_ACTIVE_CURATED_RECORD_MATCH").otherwise("A_ORIGINAL_SOURCE_CLAIM_ABSENT_FROM_CLEANED_RECORDS").alias("assessment"),
        F.when(hit, "REVIEW_REQUIRED_MATCHED").otherwise("NOT_TRUSTED_UNMATCHED").alias("trust_treatment"),
    )


def facts(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, ordinal, field_name, value, status``: explicit numbers and markers of each page, in rule order."""
    low = T.folded(F.col("_t"))
    n = K.NUMBER_PATTERN

    def each(pattern: str, group: int, field: Column | None = None):
        found = F.regexp_extract_all(F.col("_t"), F.lit(pattern), F.lit(group))
        return found

    area = F.transform(each(rf"(?i)({n})\s*(?:hectares?|ha)\b", 1), lambda x, i: F.struct(F.lit(0).alias("rule"), i.alias("pos"), F.lit("site_area_hectares").alias("field"), x.alias("raw")))
    numbers, units = each(rf"(?i)({n})\s*(MW|MVA)\b", 1), each(rf"(?i)({n})\s*(MW|MVA)\b", 2)
    power = F.transform(
        F.arrays_zip(numbers.alias("n"), units.alias("u")),
        lambda x, i: F.struct(F.lit(1).alias("rule"), i.alias("pos"), F.when(F.upper(x["u"]) == "MW", "planned_power_mw").otherwise("requested_mic_mva").alias("field"), x["n"].alias("raw")),
    )
    none = F.lit(None).cast("string")
    marks = F.array_compact(
        F.array(*[F.when(T.contains_any(low, terms), F.struct(F.lit(2 + k).alias("rule"), F.lit(0).alias("pos"), F.lit(name).alias("field"), none.alias("raw"))) for k, (name, terms) in enumerate(K.FACT_MARKERS)])
    )
    rows = pages.select(F.col(id_col).alias("id"), T.normalised(text_col).alias("_t")).where(F.length("_t") > 0)
    rows = rows.select("id", T.asset_status(F.col("_t")).alias("status"), F.posexplode(F.concat(area, power, marks)).alias("at", "f"))
    return rows.select("id", (F.col("at") + 1).alias("ordinal"), F.col("f.field").alias("field_name"), T.number(F.col("f.raw")).alias("value"), "status")


def corpus_report(documents: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row of conditional counts, all in one aggregate."""
    return documents.agg(*[F.count_if(c).alias(name) for name, c in measures.items()])


def missing_counts(documents: DataFrame, fields: list[str]) -> DataFrame:
    """``field, missing``: nulls and blanks per metadata field."""
    blank = [F.count_if(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "").alias(f) for f in fields]
    return documents.agg(*blank).unpivot([], fields, "field", "missing")


def violations(*checks: DataFrame) -> DataFrame:
    """Union of ``code, key`` checks."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def violation(rows: DataFrame, code: str, key: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), key.cast("string").alias("key"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def verification_status(source_class: Column, status: Column, review: Column) -> Column:
    return F.when(review, "REVIEW_REQUIRED").when(source_class == "SUPPORTING_INDUSTRY", "SUPPORTING_ONLY").when(status == "PROPOSED", "PROPOSED_REVIEW").otherwise("REGISTERED_SOURCE")


def curated_envelopes(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Curated records with their flags: a flagged or review-required record is not eligible."""
    flags = matches.groupBy("record_id").agg(F.array_sort(F.collect_set("flag_id")).alias("flags"))
    out = records.join(flags, "record_id", "left")
    review = F.coalesce(F.col("review_required"), F.lit(False)) | F.col("flags").isNotNull()
    return out.select(
        *records.columns,
        F.coalesce("flags", F.array().cast(out.schema["flags"].dataType)).alias("review_flags"),
        F.when(F.col("flags").isNotNull(), "MATCHED").otherwise("NO_DIRECT_FLAG_MATCH").alias("review_flag_status"),
        (F.col("retrieval_eligible") & ~review).alias("eligible"),
        F.when(review, "REVIEW_REQUIRED").otherwise("CURATED_RECORD").alias("verification_status"),
    )


def admitted_chunks(chunk_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that may enter the index: eligible themselves and of an eligible document that is no duplicate and not excluded."""
    good = documents.where(F.col("retrieval_eligible") & F.col("duplicate_of").isNull() & ~F.col("source_class").isin(*K.EXCLUDED_CLASSES)).select("document_id")
    return chunk_rows.where("retrieval_eligible").join(good, "document_id", "left_semi")


def no_text_pages(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Pages without text: an override's assessment, else visual content, else unknown."""
    blank = pages.where(~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S"))).join(F.broadcast(overrides), ["document_id", "page"], "left")
    visual = (F.col("images") > 0) | (F.col("drawings") > 0)
    return blank.select("document_id", "page", F.coalesce("assessment", F.when(visual, "VISUAL_CONTENT").otherwise("UNKNOWN")).alias("assessment"))


def corpus_digest(files: DataFrame, path_col: str, content: Column) -> DataFrame:
    """One row: SHA-256 over the ordered digests of all files (contents stay on the executors)."""
    one = files.select(F.struct(F.col(path_col).alias("p"), F.sha2(content, 256).alias("h")).alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list("f")), lambda x: F.concat(x["p"], F.lit(":"), x["h"]))
    return one.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


def english_part(text: Column) -> Column:
    """The part of a bilingual text before its translation."""
    return F.trim(F.split_part(text, F.lit(". Chinese:"), F.lit(1)))
