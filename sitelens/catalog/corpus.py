"""Corpus queries: normalising, headings, windows, rules, relations, flags, reports, violations, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog.base import RECORDS_SQL, policy_records, table
from sitelens.functions import constants as K
from sitelens.functions import text as T
from sitelens.operators import corpus


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\f\v]+(\n|$)', '\1', 'g'), '^(\s*\n)+', ''), '\s+$', '')"


def normalise_text(spark, d):
    own = T.normalised("text")
    return _docs(spark, d).select("doc_id", F.length(own).cast("long").alias("n_chars"), F.sha2(own, 256).alias("digest"))


def section_heading(spark, d):
    return _docs(spark, d).select("doc_id", T.section_heading("text").alias("heading"))


_HEADING = r"^(?:\d+(?:\.\d+)*|[A-Z])\.?\s+\S+"


def text_windows(spark, d):
    return corpus.chunks(_docs(spark, d), "doc_id", "text").select(
        "id", "chunk_index", "start", F.length("chunk_text").cast("long").alias("n_chars"), F.sha2("chunk_text", 256).alias("digest"), corpus.chunk_id(F.concat(F.lit("doc-"), F.col("id").cast("string")), F.lit(1), F.col("chunk_index")).alias("chunk_id")
    )


def heading_forward_fill(spark, d):
    c = table(spark, d, "conversations")
    heading = F.when(F.col("role") == "user", F.substring("text", 1, 40))
    return corpus.forward_filled(c, "conv_id", "turn", heading).select("conv_id", "turn", "heading")


_RULES = (("http", "WEB", 0), ("http://", "PLAIN", 1), ("https://", "SECURE", 1), ("https://m.", "MOBILE", 2), ("https://blog.", "BLOG", 2), ("ftp://", "FILES", 1))


def longest_prefix_rule(spark, d):
    rules = spark.createDataFrame(_RULES, "prefix string, source_class string, depth int")
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return corpus.longest_prefix(pages, rules).select("page_id", "prefix", "source_class", "depth")


def duplicate_canonical(spark, d):
    r = policy_records(_docs(spark, d))
    return corpus.duplicate_relations(r, "id", F.sha2("text", 256), F.col("source_class").isin("ARCHIVE", "RESTRICTED"), F.col("document_id"))


def _flags(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("flag_id"), F.concat(F.lit("src"), (F.col("item_id") * 3).cast("string")).alias("source_id"), F.col("text").alias("original_claim"))


def _flagged(spark, d) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("record_id"), F.array("source").alias("source_ids"), "text")


def flag_match(spark, d):
    return corpus.flag_matches(_flagged(spark, d), _flags(spark, d))


_FLAGS = (
    "r as (select doc_id as record_id, source, text from documents), "
    "fl as (select item_id as flag_id, 'src' || (item_id * 3) as source_id, text as claim from benchmark), "
    "m as (select distinct flag_id, record_id from fl, r where fl.source_id = r.source or contains(r.text, claim))"
)


def flag_audit(spark, d):
    return corpus.flag_audit(_flags(spark, d), flag_match(spark, d))


def corpus_report(spark, d):
    r = policy_records(_docs(spark, d))
    return corpus.corpus_report(
        r,
        {
            "documents": F.lit(True),
            "active": ~F.col("source_class").isin(*K.EXCLUDED_CLASSES),
            "primary_current": (F.col("source_class") == "PRIMARY") & (F.col("document_status") == "CURRENT"),
            "archive": F.col("source_class") == "ARCHIVE",
            "restricted": F.col("source_class") == "RESTRICTED",
            "review_required": F.col("review"),
            "eligible": F.col("eligible"),
            "missing_legal_status": F.col("legal_status").isNull(),
            "no_domain": F.size("domains") == 0,
        },
    )


def corpus_violations(spark, d):
    docs, labels = _docs(spark, d), table(spark, d, "labels")
    r = policy_records(docs)
    return corpus.violations(
        corpus.violation(corpus.duplicates(labels, "doc_id"), "DUPLICATE_LABEL", F.col("doc_id")),
        corpus.violation(labels.join(docs, "doc_id", "left_anti"), "LABEL_WITHOUT_DOCUMENT", F.col("doc_id")),
        corpus.violation(docs.where(F.trim("text") == ""), "EMPTY_TEXT", F.col("doc_id")),
        corpus.violation(docs.where(F.length("text") != F.col("n_chars")), "LENGTH_MISMATCH", F.col("doc_id")),
        corpus.violation(r.where(F.col("eligible") & F.col("source_class").isin(*K.EXCLUDED_CLASSES)), "EXCLUDED_BUT_ELIGIBLE", F.col("id")),
        corpus.violation(corpus.duplicates(docs.select("text"), "text"), "DUPLICATE_TEXT", F.sha2("text", 256)),
    )


def fact_extraction(spark, d):
    """Facts of the documents; numbers with units come from their own length and id in the same words."""
    i = F.col("doc_id")
    note = F.concat(F.lit(" The site has "), F.format_number(i * 37 % 5000, 0), F.lit(" ha and "), (i % 90 + 10).cast("string"), F.lit(" MW, "), (i % 7 + 0.5).cast("string"), F.lit(" MVA."))
    more = F.element_at(F.array(*[F.lit(x) for x in (" The solar plant is planned.", " A grid connection is proposed.", " Wastewater works are not operational.", "")]), (i % 4 + 1).cast("int"))
    rows = _docs(spark, d).select("doc_id", F.concat("text", F.when(i % 3 == 0, note).otherwise(""), more).alias("text"))
    return corpus.facts(rows, "doc_id", "text")


def _facts_sql() -> str:
    low = "replace(lower(t), 'ß', 'ss')"
    any_of = lambda terms: "(" + " or ".join(f"contains(low, '{x}')" for x in terms) + ")"
    status = f"case when {any_of(K.NEGATED_STATUS)} then 'UNKNOWN' " + " ".join(f"when contains(low, '{m}') then '{s}'" for m, s in K.STATUS_MARKERS) + " else 'UNKNOWN' end"
    n = r"(?:\d[\d,]*(?:\.\d+)?)"
    marks = ", ".join(f"case when {any_of(terms)} then {{'field': '{name}', 'raw': null::varchar}} end" for name, terms in K.FACT_MARKERS)
    return (
        "with b as (select doc_id, text || case when doc_id % 3 = 0 then ' The site has ' || format('{:,}', doc_id * 37 % 5000) || ' ha and ' || (doc_id % 90 + 10) || ' MW, ' || (doc_id % 7) || '.5 MVA.' else '' end "
        "|| [' The solar plant is planned.', ' A grid connection is proposed.', ' Wastewater works are not operational.', ''][doc_id % 4 + 1] as text from documents), "
        f"c as (select doc_id, {_NORM} as t from b), e as (select *, {low} as low from c where length(t) > 0), "
        rf"f as (select doc_id, {status} as status, list_concat(list_concat(list_transform(regexp_extract_all(t, '(?i)({n})\s*(?:hectares?|ha)\b', 1), lambda x: {{'field': 'site_area_hectares', 'raw': x}}), "
        rf"list_transform(list_zip(regexp_extract_all(t, '(?i)({n})\s*(MW|MVA)\b', 1), regexp_extract_all(t, '(?i)({n})\s*(MW|MVA)\b', 2)), lambda x: {{'field': case when upper(x[2]) = 'MW' then 'planned_power_mw' else 'requested_mic_mva' end, 'raw': x[1]}})), "
        f"list_filter([{marks}], lambda x: x is not null)) as fs from e) "
        "select doc_id as id, i::int as ordinal, fs[i].field as field_name, try_cast(replace(fs[i].raw, ',', '') as double) as value, status from f, unnest(range(1, len(fs) + 1)) u(i)"
    )


QUERIES = {
    "q32_normalise_text": normalise_text,
    "q33_section_heading": section_heading,
    "q34_text_windows": text_windows,
    "q35_heading_forward_fill": heading_forward_fill,
    "q36_longest_prefix_rule": longest_prefix_rule,
    "q37_duplicate_canonical": duplicate_canonical,
    "q38_flag_match": flag_match,
    "q39_flag_audit": flag_audit,
    "q40_corpus_report": corpus_report,
    "q41_corpus_violations": corpus_violations,
    "q42_fact_extraction": fact_extraction,
}

SQL = {
    "q32_normalise_text": f"with n as (select doc_id, {_NORM} as t from documents) select doc_id, length(t) as n_chars, sha256(t) as digest from n",
    "q33_section_heading": f"with n as (select doc_id, {_NORM} as t from documents), l as (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), "
    rf"lambda x: length(x) > 0 and length(x) <= 160 and ((upper(x) = x and lower(x) <> x) or regexp_matches(x, '{_HEADING}'))) as h from n) select doc_id, h[1] as heading from l",
    "q34_text_windows": f"with n as (select doc_id, {_NORM} as t from documents), w as (select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 3600) / 3200.0))::int + 1)) as i from n where length(t) > 0), "
    "c as (select doc_id as id, i::int as chunk_index, (i * 3200)::int as start, trim(substr(t, i * 3200 + 1, 3600), ' ') as s from w) "
    "select id, chunk_index, start, length(s) as n_chars, sha256(s) as digest, format('doc-{}-p0001-{:03d}', id, chunk_index) as chunk_id from c where s <> ''",
    "q35_heading_forward_fill": "select conv_id, turn, last_value(case when role = 'user' then substr(text, 1, 40) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading from conversations",
    "q36_longest_prefix_rule": "with r as (select * from (values " + ", ".join(f"('{p}', '{c}', {n})" for p, c, n in _RULES) + ") v(prefix, source_class, depth)) "
    "select page_id, arg_max(prefix, length(prefix)) as prefix, arg_max(source_class, length(prefix)) as source_class, arg_max(depth, length(prefix)) as depth from pages left join r on starts_with(url, prefix) group by page_id",
    "q37_duplicate_canonical": f"with r as ({RECORDS_SQL}), h as (select *, sha256(text) as g, source_class in ('ARCHIVE', 'RESTRICTED') as e from r), b as (select g, arg_min(id, (e, document_id, id)) as canonical_id, count(*) as copies from h group by g having count(*) > 1) "
    "select id, canonical_id, copies from h join b using (g) where id <> canonical_id",
    "q38_flag_match": f"with {_FLAGS} select flag_id, record_id from m",
    "q39_flag_audit": f"with {_FLAGS} select fl.flag_id, count(record_id) as n_records, min(record_id) as first_record, "
    "case when count(record_id) > 0 then 'B_ACTIVE_CURATED_RECORD_MATCH' else 'A_ORIGINAL_SOURCE_CLAIM_ABSENT_FROM_CLEANED_RECORDS' end as assessment, "
    "case when count(record_id) > 0 then 'REVIEW_REQUIRED_MATCHED' else 'NOT_TRUSTED_UNMATCHED' end as trust_treatment from fl left join m using (flag_id) group by fl.flag_id",
    "q40_corpus_report": f"with r as ({RECORDS_SQL}) select count(*) as documents, count(*) filter (source_class not in ('ARCHIVE', 'RESTRICTED', 'GOVERNANCE')) as active, "
    "count(*) filter (source_class = 'PRIMARY' and document_status = 'CURRENT') as primary_current, count(*) filter (source_class = 'ARCHIVE') as archive, count(*) filter (source_class = 'RESTRICTED') as restricted, "
    "count(*) filter (review) as review_required, count(*) filter (eligible) as eligible, count(*) as missing_legal_status, count(*) filter (len(domains) = 0) as no_domain from r",
    "q41_corpus_violations": f"with r as ({RECORDS_SQL}) select 'DUPLICATE_LABEL' as code, doc_id::varchar as key from labels group by doc_id having count(*) > 1 "
    "union all select 'LABEL_WITHOUT_DOCUMENT', doc_id::varchar from labels where doc_id not in (select doc_id from documents) union all select 'EMPTY_TEXT', doc_id::varchar from documents where trim(text) = '' "
    "union all select 'LENGTH_MISMATCH', doc_id::varchar from documents where length(text) <> n_chars union all select 'EXCLUDED_BUT_ELIGIBLE', id::varchar from r where eligible and source_class in ('ARCHIVE', 'RESTRICTED', 'GOVERNANCE') "
    "union all select 'DUPLICATE_TEXT', sha256(text) from documents group by text having count(*) > 1",
    "q42_fact_extraction": _facts_sql(),
}
