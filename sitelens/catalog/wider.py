"""Corpus builds, evaluators by domain, result leakage and changed inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.catalog.base import APPLICATIONS_SQL, ASSETS_SQL, JURISDICTIONS, RECORDS_SQL, SITES_SQL, ZONES_SQL, applications, assets, pick, policy_records, sites, sql_pick, table, zone_centres, zones
from sitelens.catalog.corpus import _NORM
from sitelens.catalog.records import FACT_NAMES
from sitelens.functions import constants as K
from sitelens.functions import geo
from sitelens.operators import bundle, evaluators, retrieval, snapshots, validity
from sitelens.plans import corpus_build

FILES = ("a.pdf", "b.docx", "note.txt", "d.PDF", "e.pdf", "rag_records.jsonl", "x/y.Docx")


def corpus_states(spark, d):
    """Documents as files by their id: some duplicates, pages with an error, without text, or missing."""
    docs = table(spark, d, "documents")
    i = F.col("document_id")
    own = policy_records(docs).select(F.col("id").alias("document_id"), "source_class", F.col("eligible").alias("retrieval_eligible"))
    own = own.withColumn("source_path", F.concat(F.lit("raw/"), pick(FILES, i))).withColumn("duplicate_of", F.when(i % 31 == 5, i - 1))
    none = F.lit(0)
    first = docs.where("doc_id % 41 <> 3").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text", none.alias("images"), none.alias("drawings"), F.when(F.col("doc_id") % 23 == 7, "PdfError: filter").alias("error"))
    blank = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("page"), F.lit("  \n").alias("text"), F.lit(1).alias("images"), none.alias("drawings"), F.lit(None).cast("string").alias("error"))
    built = corpus_build.build(own, first.union(blank))["documents"]
    return built.select("document_id", "extraction_status", "extraction_error", "page_count", "chunk_count", F.array_join("no_text_pages", ",").alias("no_text_pages"))


_BUILD_SQL = (
    f"with n as (select doc_id, {_NORM} as t from documents), w as (select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 3600) / 3200.0))::int + 1)) as i from n where length(t) > 0), "
    "c as (select doc_id, count(*) filter (trim(substr(t, i * 3200 + 1, 3600), ' ') <> '') as n from w group by doc_id), "
    f"r as (select doc_id as k, source_class as s, eligible, {sql_pick(FILES, 'doc_id')} as f from (select *, id as doc_id from ({RECORDS_SQL}))), "
    "p as (select *, case when k % 31 = 5 and eligible then 'DUPLICATE_SKIPPED' when s in ('ARCHIVE', 'RESTRICTED', 'GOVERNANCE') then 'SKIPPED_' || s when s = 'CURATED' and f = 'rag_records.jsonl' then 'CURATED_ATOMIC' "
    "when s = 'CURATED' or not eligible or not regexp_matches(lower(f), '[.](pdf|docx)$') then 'SKIPPED_METADATA' else 'EXTRACTED' end as plan from r), "
    "e as (select *, case when plan = 'EXTRACTED' then case when k % 23 = 7 and k % 41 <> 3 then 'PdfError: filter' when k % 41 = 3 and k % 4 <> 0 then 'no page could be read' end end as error from p), "
    "g as (select *, plan = 'EXTRACTED' and error is null as good from e) "
    "select k as document_id, case when error is not null then 'FAILED' else plan end as extraction_status, error as extraction_error, case when good then (k % 41 <> 3)::bigint + (k % 4 = 0)::bigint end as page_count, "
    "case when good and k % 41 <> 3 then coalesce(c.n, 0) else 0 end as chunk_count, "
    "case when good then concat_ws(',', case when k % 41 <> 3 and not regexp_matches(coalesce(d.text, ''), '\\S') then '1' end, case when k % 4 = 0 then '2' end) else '' end as no_text_pages from g left join c on c.doc_id = k left join documents d on d.doc_id = k"
)


def leakage(spark, d):
    """Records as results of a request each; nations as requests, every third without a jurisdiction."""
    n = F.col("n_nationkey")
    requests = table(spark, d, "nation").select(n.alias("qid"), F.when(n % 3 > 0, pick(JURISDICTIONS, n)).alias("jurisdiction"))
    rows = policy_records(table(spark, d, "documents")).withColumn("verification_status", F.when(F.col("id") % 19 == 4, "REVIEW_REQUIRED"))
    return retrieval.leakage(rows.select((F.col("id") % 29).alias("qid"), "source_class", "document_status", "jurisdiction", "review", "verification_status"), requests)


_LEAK_SQL = (
    f"with q as (select n_nationkey as qid, case when n_nationkey % 3 > 0 then {sql_pick(JURISDICTIONS, 'n_nationkey')} end as asked from nation), "
    f"r as (select id % 29 as qid, source_class as s, document_status as t, jurisdiction as j, review or id % 19 = 4 as flagged from ({RECORDS_SQL})), "
    "p as (select q.qid, bool_or(s = 'PRIMARY' and t = 'CURRENT') as a, bool_or(t in ('PROPOSED', 'HISTORICAL', 'SUPERSEDED')) as h, bool_or(s in ('RESTRICTED', 'ARCHIVE')) as x, "
    "bool_or(asked is not null and not (j = asked or (asked = 'IRELAND' and j in ('LOCAL_AUTHORITY', 'EU')))) as w, bool_or(flagged) as f from q left join r on r.qid = q.qid group by q.qid) "
    "select count(*) as cases, round(count(*) filter (a) / count(*)::double, 6) as authoritative_source_hit_rate, round(count(*) filter (h) / count(*)::double, 6) as historical_leakage_rate, "
    "round(count(*) filter (x) / count(*)::double, 6) as restricted_archive_leakage_rate, round(count(*) filter (w) / count(*)::double, 6) as jurisdiction_leakage_rate, round(count(*) filter (f) / count(*)::double, 6) as flagged_claim_leakage_rate from p"
)

_ZONE_PAIRS = f"s as ({SITES_SQL}), z as ({ZONES_SQL}), p as (select *, greatest(abs(x - zx) - half, 0) as dx, greatest(abs(y - zy) - half, 0) as dy from s, z), dist as (select *, sqrt(dx * dx + dy * dy) as dd from p)"


def biodiversity(spark, d):
    areas = zones(table(spark, d, "part")).withColumn("kind", pick(("SAC", "SPA"), F.col("feature_id")))
    return evaluators.biodiversity(sites(table(spark, d, "supplier")), areas).withColumn("nearest_distance", F.round("nearest_distance", 3))


_BIO_SQL = f"with {_ZONE_PAIRS} select site_id, {sql_pick(('SAC', 'SPA'), 'feature_id')} as kind, min(dd) = 0 as intersects, arg_min(feature_id, (dd, feature_id)) as nearest_feature_id, round(min(dd), 3) as nearest_distance from dist group by 1, 2"

LAYERS = (("zone_0_0100", "river.zip", True), ("zone_1_1000", "ext_c_2.zip", True), ("zone_2", "lake.zip", False))


def flood(spark, d):
    extents = zones(table(spark, d, "part")).withColumn("source_layer", pick(tuple(n for n, _, _ in LAYERS), F.col("feature_id")))
    return evaluators.flood(sites(table(spark, d, "supplier")), extents, LAYERS).withColumn("nearest_distance", F.round("nearest_distance", 3))


_FLOOD_SQL = (
    f"with {_ZONE_PAIRS}, m as (select site_id, feature_id % 3 as k, min(dd) = 0 as hit, arg_min(feature_id, (dd, feature_id)) as f, min(dd) as d0 from dist where feature_id % 3 < 2 group by 1, 2) "
    "select site_id, case k when 0 then 'fluvial' else 'coastal' end as flood_type, case k when 0 then 'zone_0_0100' else 'zone_1_1000' end as source_layer, case k when 0 then '0100' else '1000' end as return_period, 'FACT' as state, hit as intersects, "
    "case when not hit then f end as nearest_feature_id, case when not hit then round(d0, 3) end as nearest_distance from m "
    "union all select site_id, 'fluvial', 'zone_2', null, 'UNKNOWN', null, null, null from s"
)


def ground(spark, d):
    part = table(spark, d, "part")
    lines = zone_centres(part).select("feature_id", F.array(F.array(geo.point(F.col("zx") - F.col("half"), F.col("zy")), geo.point(F.col("zx") + F.col("half"), F.col("zy")))).alias("rings"))
    found = evaluators.ground(sites(table(spark, d, "supplier")), zones(part).where("feature_id % 4 = 3"), assets(table(spark, d, "customer")).select("feature_id", "x", "y"), lines)
    return found.withColumns({c: F.round(c, 3) for c in ("karst_distance", "connection_distance")})


def _counts(alias: str, distance: str) -> str:
    return ", ".join(f"count(*) filter ({distance} <= {r}) as n_{r // 1000}_km" for r in K.SITE_RADII_M)


_GROUND_SQL = (
    f"with {_ZONE_PAIRS}, w as (select site_id, count(*) as groundwater, count(*) > 1 as multiple, string_agg(feature_id::varchar, ',' order by feature_id) as groundwater_ids from dist where dd = 0 and feature_id % 4 = 3 group by site_id), "
    f"a as (select *, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) as ad from s, ({ASSETS_SQL})), "
    f"k as (select site_id, {_counts('a', 'ad')}, arg_min(feature_id, (ad, feature_id)) as karst_id, round(min(ad), 3) as karst_distance from a group by site_id), "
    "l as (select *, sqrt(dx * dx + (y - zy) * (y - zy)) as ld from p), c as (select site_id, arg_min(feature_id, (ld, feature_id)) as connection_id, round(min(ld), 3) as connection_distance, min(ld) = 0 as connection_intersects from l group by site_id) "
    "select k.*, coalesce(groundwater, 0) as groundwater, coalesce(multiple, false) as multiple, coalesce(groundwater_ids, '') as groundwater_ids, connection_id, connection_distance, connection_intersects from k join c using (site_id) left join w using (site_id)"
)


def heritage(spark, d):
    return evaluators.heritage(sites(table(spark, d, "supplier")), zones(table(spark, d, "part")), applications(table(spark, d, "orders")))


_HERITAGE_SQL = (
    f"with {_ZONE_PAIRS}, h as (select site_id, count(*) as n, count(*) > 1 as multiple, string_agg(feature_id::varchar, ',' order by feature_id) as feature_ids from dist where dd = 0 group by site_id), "
    f"a as (select *, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) as ad from s, ({APPLICATIONS_SQL})), k as (select site_id, {_counts('a', 'ad')} from a group by site_id) "
    "select k.*, coalesce(n, 0) as n, coalesce(multiple, false) as multiple, coalesce(feature_ids, '') as feature_ids from k left join h using (site_id)"
)


def changed_inputs(spark, d):
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    before = text('{"planned_power_mw": ', k % 3, ', "location": {"address": "a', k % 2, '", "latitude": 1.50}, "project_id": ', k, ', "tags": []}')
    after = text('{"tags": [], "location": {"latitude": 1.5, "address": "a1"}, "planned_power_mw": ', k % 4, ', "site_boundary": {"area_hectares": 2.0}, "project_id": 7}')
    rows = table(spark, d, "supplier")
    return snapshots.input_diff(rows.select(k.alias("pair_id"), before.alias("context")), rows.select(k.alias("pair_id"), after.alias("context")))


_INPUT_SQL = (
    "with r as (select s_suppkey as k, unnest(['planned_power_mw', 'location.address', 'location.latitude', 'tags', 'site_boundary.area_hectares']) as path from supplier), "
    "v as (select k, path, case path when 'planned_power_mw' then (k % 3)::varchar when 'location.address' then '\"a' || k % 2 || '\"' when 'location.latitude' then '1.5' when 'tags' then '[]' end as a, "
    "case path when 'planned_power_mw' then (k % 4)::varchar when 'location.address' then '\"a1\"' when 'location.latitude' then '1.5' when 'tags' then '[]' else '2.0' end as b from r), "
    "t as (select *, case path when 'planned_power_mw' then ' MW' when 'site_boundary.area_hectares' then ' hectares' else '' end as unit from v) "
    "select k as pair_id, path, case path " + " ".join(f"when '{p}' then '{K.INPUT_LABELS[p]}'" for p in ("planned_power_mw", "location.address", "location.latitude", "site_boundary.area_hectares") if p in K.INPUT_LABELS) + " else 'Tags' end as label, "
    "a as previous, b as current, case when a is null then 'Unknown / Not provided' when a = '[]' then 'None recorded' else trim(a, '\"') || unit end as previous_display, "
    "case when b = '[]' then 'None recorded' else trim(b, '\"') || unit end as current_display, case when a is not distinct from b then 'unchanged' else 'changed' end as change_kind from t"
)

ISSUERS = ("CRU", " ", "EirGrid")


def _hits(spark, d):
    """Records as search hits of fifty projects, each found by two queries of which the first in order counts."""
    i = F.col("id")
    rows = policy_records(table(spark, d, "documents")).select(
        (i % 50).alias("project_id"), F.concat(F.lit("r"), i.cast("string")).alias("record_key"), F.element_at(F.concat("domains", F.array(F.lit("GENERAL"))), 1).alias("domain"),
        F.when(i % 7 != 2, F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("document_id"), pick(ISSUERS, i).alias("issuer"),
        F.lit(None).cast("string").alias("source_path"), F.when(i % 6 != 3, F.substring("text", 1, 30)).alias("text"), F.when(i % 9 != 4, F.col("source_class")).alias("source_class"), "document_status",
        F.when(i % 3 == 0, "REGISTERED_SOURCE").alias("verification_status"), F.when(i % 4 != 1, F.col("review")).alias("review"),
    )
    twice = rows.withColumn("query", F.lit(1)).union(rows.withColumn("domain", F.lit("OTHER")).withColumn("query", F.lit(2)))
    return bundle.first_hits(twice, ("query",)).drop("query")


POLICY = ("project_id", "evidence_id", "domain", "field_name", "fact", "source_name", "source_reference", "source_class", "document_status", "state", "confidence", "verification_status", "limitation", "human_review_required")


def policy_evidence(spark, d):
    return bundle.policy_records(_hits(spark, d)).select(*POLICY)


_HITS_SQL = (
    f"h as (select id % 50 as project_id, 'r' || id as k, case when len(domains) > 0 then domains[1] else 'GENERAL' end as domain, case when id % 7 <> 2 then 'T' || id else 'd' || document_id end as title, "
    f"trim({sql_pick(ISSUERS, 'id')}) as issuer, coalesce(case when id % 6 <> 3 then substr(text, 1, 30) end, '') as text, coalesce(case when id % 9 <> 4 then source_class end, 'UNKNOWN') as kind, document_status as status, "
    f"case when id % 3 = 0 then 'REGISTERED_SOURCE' else 'UNVERIFIED' end as verified, coalesce(case when id % 4 <> 1 then review end, false) as review from ({RECORDS_SQL}))"
)
_POLICY_SQL = (
    f"with {_HITS_SQL} select project_id, 'rag-' || k as evidence_id, domain, 'policy.' || lower(domain) as field_name, case when text <> '' then text else 'Retrieved evidence from ' || title end as fact, "
    "case when issuer <> '' then issuer || ' — ' || title else title end as source_name, k as source_reference, kind as source_class, status as document_status, 'PROVIDED' as state, "
    "case when kind = 'PRIMARY' then 'HIGH' else 'MEDIUM' end as confidence, verified as verification_status, "
    "case when status <> 'CURRENT' then 'Policy version is not current; excluded from normal current-policy evidence.' when kind not in ('PRIMARY', 'CURATED') then 'Supporting evidence; it is not a primary authority.' end as limitation, "
    "review as human_review_required from h"
)


def _project_parts(spark, d):
    i = F.col("page_id")
    pages = table(spark, d, "pages")
    place = [(i % 50).alias("project_id"), F.concat(F.lit("p"), (i % 9).cast("string")).alias("project_document_id"), F.lit("https://example.org/a").alias("source_url"), F.lit("page 1").alias("locator")]
    facts = pages.where("page_id % 2 = 0").select(*place, i.cast("string").alias("fact_id"), pick(FACT_NAMES, i).alias("field_name"), F.when(i % 3 > 0, i.cast("string")).alias("value"), F.lit("PLANNED").alias("status"), (i % 5 == 0).alias("benchmark_only"))
    chunks = pages.where("page_id % 2 = 1").select(*place, i.cast("string").alias("chunk_id"), F.when(i % 3 > 0, "GRID").alias("domain"), F.lit("words").alias("text"))
    return bundle.project_fact_records(facts), bundle.project_chunk_records(chunks)


def project_evidence(spark, d):
    """Addresses look like drive paths to the rule that hides those, and are cut at their scheme."""
    facts, chunks = _project_parts(spark, d)
    return facts.union(chunks).select("project_id", "evidence_id", "domain", "field_name", "fact", "state", "source_name", "source_reference")


def _facts_sql() -> str:
    cases = " ".join(f"when {' or '.join(f'contains(lower(f), $${w}$$)' for w in words)} then '{domain}'" for words, domain in K.FACT_DOMAINS)
    return (
        f"f as (select page_id as i, page_id % 50 as project_id, {sql_pick(FACT_NAMES, 'page_id')} as f, case when page_id % 3 > 0 then page_id::varchar end as v from pages where page_id % 2 = 0), "
        f"o as (select project_id, 'project-fact-' || i as evidence_id, case {cases} else 'GENERAL' end as domain, 'project.' || f as field_name, "
        "f || ': {\"benchmark_only\": ' || (i % 5 = 0)::varchar || ', \"status\": \"PLANNED\", \"value\": ' || coalesce(v, 'null') || '}' as fact, case when v is null then 'UNKNOWN' else 'PROVIDED' end as state, i % 9 as doc from f "
        "union all select page_id % 50, 'project-chunk-' || page_id, case when page_id % 3 > 0 then 'GRID' else 'UNKNOWN' end, case when page_id % 3 > 0 then 'project_document.grid' else 'project_document.unknown' end, 'words', 'PROVIDED', page_id % 9 from pages where page_id % 2 = 1)"
    )


def evidence_bundle(spark, d):
    """Per project what a bundle of policy and project evidence holds."""
    none = table(spark, d, "nation").limit(0).select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("item"))
    facts, chunks = _project_parts(spark, d)
    whole = bundle.assemble({"policy": bundle.policy_records(_hits(spark, d)), "project": facts.unionByName(chunks)}, none)
    records = whole["records"].groupBy("project_id").agg(F.count_if(F.col("source_order") == 2).alias("policy"), F.count_if(F.col("source_order") == 3).alias("project"))
    missing = whole["missing"].groupBy("project_id").agg(F.count("*").alias("missing"))
    return records.join(missing, "project_id", "left").na.fill(0, ["missing"])


_BUNDLE_SQL = (
    f"with {_HITS_SQL}, {_facts_sql()}, a as (select project_id, 1 as p, 0 as q, null as m from h union all select project_id, 0, 1, case when state = 'UNKNOWN' then domain || field_name end from o) "
    "select project_id, sum(p)::bigint as policy, sum(q)::bigint as project, count(distinct m) as missing from a group by project_id"
)

TITLES = ("Plan", "Proposed plan", "Decision")


def corpus_violations(spark, d):
    """A corpus with faults by its ids: all eighteen conditions on documents, chunks, files, records, flags and reports."""
    i, none = F.col("id"), F.array().cast("array<int>")
    rows = policy_records(table(spark, d, "documents"))
    docs = rows.select(
        i.alias("document_id"), F.concat(F.when(i % 37 < 5, "raw/CRU/").otherwise("raw/x/"), i.cast("string")).alias("source_path"), F.concat(F.lit("h"), i.cast("string")).alias("sha256"), "source_class",
        F.when(i % 43 == 2, "PRIMARY").otherwise(F.col("source_class")).alias("authority_class"), "document_status", pick(TITLES, i).alias("title"), (F.col("eligible") | (i % 29 == 1)).alias("retrieval_eligible"),
        F.when(i % 31 == 5, i - 1).alias("duplicate_of"), (i % 3).alias("chunk_count"), F.when(i % 4 == 0, F.array(F.lit(1))).otherwise(none).alias("no_text_pages"),
    )
    p = F.col("page_id")
    chunks = table(spark, d, "pages").select(F.when(p % 101 == 0, "c0").otherwise(F.concat(F.lit("c"), p.cast("string"))).alias("chunk_id"), (p * 3).alias("document_id"), (p % 5).alias("page_start"), (p % 7).alias("page_end"))
    files = docs.where("document_id % 17 <> 3").select("source_path", F.when(F.col("document_id") % 19 == 2, "other").otherwise(F.col("sha256")).alias("sha256"))
    c = F.col("c_custkey")
    curated = table(spark, d, "customer").select(c.alias("record_id"), F.when(c % 3 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("review_flags"), (c % 2 == 0).alias("retrieval_eligible"))
    n = F.col("n_nationkey")
    flags = table(spark, d, "nation").select(
        n.alias("flag_id"), F.when(n % 4 == 0, "NOT_TRUSTED_UNMATCHED").otherwise("REVIEW_REQUIRED_MATCHED").alias("trust_treatment"), F.when(n % 3 == 1, F.array().cast("array<long>")).otherwise(F.array(n + 1, n * 6, n - 1000)).alias("matched_record_ids")
    )
    no_text = docs.where("document_id % 4 = 0 and document_id % 20 <> 0").select("document_id", F.lit(1).alias("page"))
    quality = docs.where("source_class = 'PRIMARY' and document_id % 50 <> 0").select("document_id")
    return validity.corpus_errors(docs, chunks, files, curated, flags, no_text, quality)


def _violations_sql() -> str:
    rule = lambda code, key, source: f"select '{code}' as code, ({key})::varchar as key from {source}"
    rules = [
        "select 'DUPLICATE_CHUNK_ID' as code, 'chunks' as key where exists (select 1 from c group by chunk_id having count(*) > 1)",
        rule("CHUNK_WITHOUT_DOCUMENT", "chunk_id", "c where not exists (select 1 from d where d.k = c.doc)"),
        rule("EXCLUDED_DOCUMENT_HAS_CHUNK", "path", "c join d on d.k = c.doc where not d.ok"),
        rule("INVALID_PAGE_RANGE", "chunk_id", "c where a > b"),
        rule("SOURCE_MISSING", "path", "d where k % 17 = 3"),
        rule("SOURCE_CHANGED", "path", "d where k % 17 <> 3 and k % 19 = 2"),
        rule("EXCLUDED_CLASS_HAS_CHUNKS", "path", "d where s in ('ARCHIVE', 'RESTRICTED', 'GOVERNANCE') and k % 3 > 0"),
        rule("EXCLUDED_CLASS_ELIGIBLE", "path", "d where s in ('ARCHIVE', 'RESTRICTED') and ok"),
        rule("INDUSTRY_AS_PRIMARY", "path", "d where s = 'SUPPORTING_INDUSTRY' and k % 43 = 2"),
        rule("DUPLICATE_HAS_CHUNKS", "path", "d where k % 31 = 5 and k % 3 > 0"),
        "select 'PROPOSED_LABELLED_CURRENT', 'cru' where exists (select 1 from d where cru and t = 'CURRENT' and title = 'Proposed plan') and exists (select 1 from d where cru and t in ('PROPOSED', 'HISTORICAL'))",
        rule("FLAGGED_RECORD_ELIGIBLE", "c_custkey", "customer where c_custkey % 3 = 0 and c_custkey % 2 = 0"),
        rule("UNMATCHED_FLAG_HAS_MATCHES", "f", "(select distinct f from m) where f % 4 = 0"),
        rule("FLAG_WITHOUT_RECORD", "r", "m where r not in (select c_custkey from customer)"),
        rule("FLAGGED_RECORD_NOT_EXCLUDED", "r", "m where r in (select c_custkey from customer) and (r % 3 <> 0 or r % 2 = 0)"),
        "select 'NO_TEXT_REPORT_DIFFERS', 'pages' where exists (select 1 from d where k % 20 = 0)",
        "select 'PRIMARY_REPORT_DIFFERS', 'documents' where exists (select 1 from d where s = 'PRIMARY' and k % 50 = 0)",
    ]
    return (
        f"with d as (select id as k, case when id % 37 < 5 then 'raw/CRU/' else 'raw/x/' end || id as path, id % 37 < 5 as cru, source_class as s, document_status as t, {sql_pick(TITLES, 'id')} as title, eligible or id % 29 = 1 as ok from ({RECORDS_SQL})), "
        "c as (select case when page_id % 101 = 0 then 'c0' else 'c' || page_id end as chunk_id, page_id * 3 as doc, page_id % 5 as a, page_id % 7 as b from pages), "
        "m as (select n_nationkey as f, unnest([n_nationkey + 1, n_nationkey * 6, n_nationkey - 1000]) as r from nation where n_nationkey % 3 <> 1) " + " union all ".join(rules)
    )


STATES = ("CONSTRAINED", "CONDITIONAL", "UNKNOWN", "CLEAR", "", "PARTIAL")
FOUND_DOMAINS = ("GRID", "WATER", "PLANNING")


def finding_texts(spark, d):
    k = F.col("p_partkey")
    some = lambda every, *items: F.when(k % every == 0, F.array().cast("array<string>")).otherwise(F.array(*items))
    f = {
        "status": pick(STATES, k),
        "domain": pick(FOUND_DOMAINS, k),
        "constraint": F.when(k % 4 > 0, F.concat(F.lit("limit "), k.cast("string"))),
        "impact": F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("impact "), (k % 9).cast("string"))),
        "unknowns": some(7, F.lit("capacity"), F.concat(F.lit("u"), (k % 2).cast("string")), F.lit("capacity")),
        "required_next": some(3, F.lit("offer"), F.lit("survey")),
        "evidence_ids": some(8, F.concat(F.lit("e"), k.cast("string")), F.lit("e0"), F.lit("e0")),
        "finding_id": F.concat(F.lit("f"), k.cast("string")),
    }
    return table(spark, d, "part").select(k.alias("part_id"), bundle.finding_text(f).alias("text"))


_TEXT_SQL = (
    f"with p as (select p_partkey as k, {sql_pick(STATES, 'p_partkey')} as s, {sql_pick(FOUND_DOMAINS, 'p_partkey')} as d from part), "
    "t as (select *, case when k % 4 > 0 then 'limit ' || k end as c, case when k % 5 > 0 then 'impact ' || k % 9 end as i, case when k % 7 > 0 then 'capacity; u' || k % 2 else d || ' evidence is incomplete.' end as u from p) "
    "select k as part_id, case s when 'CONSTRAINED' then s || ' — ' || d || ': ' || coalesce(c, 'A constrained status is recorded by the assessment.') "
    "when 'CONDITIONAL' then s || ' — ' || d || ': ' || coalesce(i, 'This issue is potentially resolvable, subject to further evidence or specialist review.') "
    "when 'UNKNOWN' then s || ' — ' || d || ': The assessment has not found sufficient evidence to confirm ' || u || '.' "
    "when 'CLEAR' then s || ' — ' || d || ': ' || coalesce(i, 'No explicit hard constraint was identified in the supplied evidence.') "
    "else case s when '' then 'NOT_ASSESSED' else s end || ' — ' || d || ': The assessment did not classify this domain as resolved.' end "
    "|| case when k % 3 > 0 then ' Evidence that could resolve or progress this item: offer; survey.' else '' end || ' [finding: f' || k || ']' || case when k % 8 > 0 then ' [evidence: e' || k || ', e0]' else '' end as text from t"
)

QUERIES = {
    "q88_corpus_violations": corpus_violations,
    "q87_finding_texts": finding_texts,
    "q84_policy_evidence": policy_evidence,
    "q85_project_evidence": project_evidence,
    "q86_evidence_bundle": evidence_bundle,
    "q77_corpus_build": corpus_states,
    "q78_result_leakage": leakage,
    "q79_biodiversity": biodiversity,
    "q80_flood": flood,
    "q81_ground": ground,
    "q82_heritage": heritage,
    "q83_changed_inputs": changed_inputs,
}

SQL = {
    "q88_corpus_violations": _violations_sql(),
    "q87_finding_texts": _TEXT_SQL,
    "q84_policy_evidence": _POLICY_SQL,
    "q85_project_evidence": f"with {_facts_sql()} select project_id, evidence_id, domain, field_name, fact, state, 'PROJECT DOCUMENT — p' || doc as source_name, 'http<path>::page 1' as source_reference from o",
    "q86_evidence_bundle": _BUNDLE_SQL,
    "q77_corpus_build": _BUILD_SQL,
    "q78_result_leakage": _LEAK_SQL,
    "q79_biodiversity": _BIO_SQL,
    "q80_flood": _FLOOD_SQL,
    "q81_ground": _GROUND_SQL,
    "q82_heritage": _HERITAGE_SQL,
    "q83_changed_inputs": _INPUT_SQL,
}
