"""Record queries: metadata from paths, histograms, digests, plans, project facts, findings in words, compared runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.catalog.base import CLASSES, STATUSES, pick, policy_records, sql_pick, table
from sitelens.functions import constants as K
from sitelens.operators import bundle, evaluators, inference, snapshots, validity

FOLDERS = ("raw/local_authority/Fingal/planning", "raw/eu_acts/energy-efficiency", "x/primary/ireland/grid", "curated", "raw/water/uisce", "Other.Place")
NAMES = ("plan_one.v2.pdf", "bundle.zip", "rag_records.jsonl", "review_flags.jsonl", "rows.jsonl", "source_registry.json", "plain.json", "no_suffix")
CONFIGURED = ("", "IRELAND", "MARS", "UNKNOWN", "EU")
SEGMENTS = {"/planning": ("PLANNING", "GENERAL"), "grid": ("GRID", "ENERGY", "NO_SUCH"), "water": ("WATER",), "energy": ("ENERGY", "GRID")}
FLOWS = {"PLANNING": ("a", "b"), "GRID": ("b", "c"), "ENERGY": ("c", "d")}


def path_metadata(spark, d):
    i = F.col("page_id")
    rows = table(spark, d, "pages").select(i, F.concat_ws("/", pick(FOLDERS, i), pick(NAMES, i * 7 + 3)).alias("path"), pick(CONFIGURED, i * 3 + 1).alias("configured"))
    found = rows.withColumn("jurisdiction", inference.jurisdiction(F.col("path"), F.col("configured"))).withColumn("found", inference.domains(F.col("path"), SEGMENTS))
    return found.select(
        "page_id",
        "jurisdiction",
        F.coalesce(inference.jurisdiction_detail(F.col("path"), F.col("jurisdiction"), F.lit("")), F.lit("")).alias("detail"),
        inference.document_type(F.col("path")).alias("document_type"),
        inference.title(F.col("path")).alias("title"),
        F.array_join("found", ",").alias("domains"),
        F.array_join(inference.workflows(F.col("found"), FLOWS), ",").alias("workflows"),
    )


# The SQL states what each folder and each name must give.
_FOLDER_FACTS = (("LOCAL_AUTHORITY", "PLANNING,GENERAL", "a,b"), ("EU", "ENERGY,GRID,EU_REPORTING", "c,d,b"), ("IRELAND", "GRID,ENERGY", "b,c,d"), ("UNKNOWN", "UNKNOWN", ""), ("IRELAND", "WATER", ""), ("UNKNOWN", "UNKNOWN", ""))
_NAME_FACTS = (
    (None, "plan one.v2"), ("ARCHIVE_PACKAGE", "bundle"), ("CURATED_KNOWLEDGE_RECORDS", "rag records"), ("CURATED_REVIEW_METADATA", "review flags"),
    ("JSONL_SOURCE", "rows"), ("CURATED_PROVENANCE_METADATA", "source registry"), ("JSON_SOURCE", "plain"), (None, "no suffix"),
)
_FOLDER_TYPES = ("PLANNING_DOCUMENT", "POLICY_OR_RESEARCH_DOCUMENT", "SYSTEM_OPERATOR_POLICY_OR_TECHNICAL", "POLICY_OR_RESEARCH_DOCUMENT", "CAPACITY_REGISTER", "POLICY_OR_RESEARCH_DOCUMENT")


def _path_sql() -> str:
    names = sql_pick(tuple(n or "" for n, _ in _NAME_FACTS), "page_id * 7 + 3")
    return (
        f"with p as (select page_id, {sql_pick(CONFIGURED, 'page_id * 3 + 1')} as c, {sql_pick(tuple(f[0] for f in _FOLDER_FACTS), 'page_id')} as inferred, "
        f"{sql_pick(_FOLDER_TYPES, 'page_id')} as folder_type, {names} as named, {sql_pick(tuple(t for _, t in _NAME_FACTS), 'page_id * 7 + 3')} as title, "
        f"{sql_pick(tuple(f[1] for f in _FOLDER_FACTS), 'page_id')} as domains, {sql_pick(tuple(f[2] for f in _FOLDER_FACTS), 'page_id')} as workflows from pages), "
        "j as (select *, case when c in ('IRELAND', 'EU') then c else inferred end as jurisdiction from p) "
        "select page_id, jurisdiction, case when jurisdiction = 'LOCAL_AUTHORITY' then 'Fingal' when jurisdiction = 'IRELAND' then 'Ireland' when jurisdiction = 'EU' then 'European Union' else '' end as detail, "
        "case when named = '' then folder_type else named end as document_type, title, domains, workflows from j"
    )


def histograms(spark, d):
    return validity.histograms(policy_records(table(spark, d, "documents")), "source_class", "document_status", "legal_status")


def source_changes(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i.cast("string").alias("source_path"), "text", i)
    manifest = docs.select("source_path", F.sha2("text", 256).alias("sha256"))
    now = docs.where(i % 7 != 3).select("source_path", F.sha2(F.when(i % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return validity.changed_sources(manifest, now)


SHAPES = (("Polygon", "MultiPolygon"), ("Polygon", "Point"), ("MultiPolygon",), ("LineString",))


def polygon_sources(spark, d):
    i = F.col("page_id")
    kinds = F.when(i % 5 == 4, F.array().cast("array<string>"))
    for n, shape in enumerate(SHAPES):
        kinds = kinds.when(i % 5 == n, F.array(*[F.lit(s) for s in shape]))
    return table(spark, d, "pages").select("page_id", evaluators.polygon_source(kinds).alias("polygons"))


def fallback_plan(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    return bundle.fallback_plan(rows, F.col("project_id") % 3 == 0)


def _fallback_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [
        ("POLICY_RAG_SEARCH", x, f"Identify current authoritative {x.lower()} policy evidence relevant to this project.", "HIGH" if x in ("GRID", "PLANNING") else "MEDIUM", "false") for x in K.PLAN_POLICY_DOMAINS
    ]
    rows += [("GIS_SITE_EVIDENCE", x, f"Run deterministic site evidence for {x.lower()} where the submitted location supports it.", "MEDIUM", "false") for x in K.PLAN_SITE_DOMAINS]
    rows.append(("DEVELOPER_INPUT_EVIDENCE", "GENERAL", "Preserve structured developer input evidence and unknown values.", "HIGH", "true"))
    rows.append(("PROJECT_DOCUMENT_SEARCH", "GENERAL", K.PLAN_DOCUMENT_QUERY, "MEDIUM", "false"))
    values = ", ".join(f"({n}::int, {', '.join(text(v) for v in r[:4])}, {r[4]})" for n, r in enumerate(rows))
    return (
        f"select c_custkey as project_id, position, tool, domain, query, priority, required from customer, (values {values}) v(position, tool, domain, query, priority, required) "
        "where tool <> 'PROJECT_DOCUMENT_SEARCH' or c_custkey % 3 = 0"
    )


FACT_NAMES = tuple(f"Total {words[0]} note" for words, _ in K.FACT_DOMAINS) + ("colour",)


def fact_domains(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", bundle.fact_domain(F.upper(pick(FACT_NAMES, i))).alias("domain"))


def _fact_sql() -> str:
    cases = " ".join(f"when {' or '.join(f'contains(f, $${w}$$)' for w in words)} then '{domain}'" for words, domain in K.FACT_DOMAINS)
    return f"with p as (select page_id, lower({sql_pick(FACT_NAMES, 'page_id')}) as f from pages) select page_id, case {cases} else 'GENERAL' end as domain from p"


def compared_runs(spark, d):
    """Two runs a supplier: findings 0 to k % 3 before and 1 to k % 4 + 1 after; a status turns where (k + number) is a multiple of 3, and a
    number is written 50 before and 50.0 after for every fifth supplier."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")

    def result(first: int, last, turned: str, after: str):
        finding = lambda n: F.struct(
            F.concat(F.lit("f"), n.cast("string")).alias("finding_id"),
            F.element_at(F.array(*[F.lit(x) for x in ("GRID", "WATER", "PLANNING")]), (n % 3).cast("int") + 1).alias("domain"),
            F.when((k + n) % 3 == 0, turned).otherwise("CLEAR").alias("status"),
            F.array(F.concat(F.lit("e"), (n % 2).cast("string"))).alias("evidence_ids"),
            F.when(k % 5 == 0, after).otherwise("50").alias("power"),
        )
        made = F.to_json(F.struct(F.struct(F.transform(F.sequence(F.lit(first).cast("long"), last), finding).alias("findings")).alias("assessment_result"), none.alias("run_note")))
        return F.regexp_replace(made, '"power":"([^"]*)"', '"power":$1')

    pairs = table(spark, d, "supplier").select(
        k.alias("pair_id"),
        F.to_json(F.struct(F.lit(5).alias("planned_power_mw"), (k % 2).alias("phase"))).alias("baseline_context"),
        result(0, k % 3, "UNKNOWN", "50").alias("baseline_result"),
        F.to_json(F.struct(F.lit(5).alias("planned_power_mw"), (k % 4).alias("phase"))).alias("comparison_context"),
        result(1, k % 4 + 1, "CONSTRAINED", "50.0").alias("comparison_result"),
    )
    return snapshots.comparison(pairs)["items"]


_COMPARED = (
    "with b as (select s_suppkey as k, unnest(range(0, s_suppkey % 3 + 1)) as n from supplier), c as (select s_suppkey as k, unnest(range(1, s_suppkey % 4 + 2)) as n from supplier), "
    "f as (select coalesce(b.k, c.k) as k, 'f' || coalesce(b.n, c.n) as identity, case when b.k is null then 'added' when c.k is null then 'removed' when (b.k + b.n) % 3 = 0 or b.k % 5 = 0 then 'changed' else 'unchanged' end as change_kind, "
    "concat_ws(',', case when b.k % 5 = 0 then 'power' end, case when (b.k + b.n) % 3 = 0 then 'status' end) as changes "
    "from b full join c on b.k = c.k and b.n = c.n), "
    "eb as (select distinct k, 'e' || n % 2 as identity from b), ec as (select distinct k, 'e' || n % 2 as identity from c), "
    "e as (select coalesce(eb.k, ec.k) as k, coalesce(eb.identity, ec.identity) as identity, case when eb.k is null then 'added' when ec.k is null then 'removed' else 'unchanged' end as change_kind "
    "from eb full join ec on eb.k = ec.k and eb.identity = ec.identity) "
    "select k as pair_id, 'findings' as section, identity, change_kind, case when change_kind = 'changed' then changes else '' end as changed_fields from f "
    "union all select k, 'evidence', identity, change_kind, '' from e"
)


QUERIES = {
    "q68_path_metadata": path_metadata,
    "q69_histograms": histograms,
    "q70_source_changes": source_changes,
    "q71_polygon_sources": polygon_sources,
    "q72_fallback_plan": fallback_plan,
    "q73_fact_domains": fact_domains,
    "q74_compared_runs": compared_runs,
}

SQL = {
    "q68_path_metadata": _path_sql(),
    "q69_histograms": f"with r as (select {sql_pick(CLASSES, 'doc_id')} as c, {sql_pick(STATUSES, 'doc_id')} as s from documents) "
    "select 'source_class' as field, c as value, count(*) as n from r group by c union all select 'document_status', s, count(*) from r group by s union all select 'legal_status', null, count(*) from r having count(*) > 0",
    "q70_source_changes": "select doc_id::varchar as source_path, case when doc_id % 7 = 3 or text is null then 'MISSING' when doc_id % 5 = 1 then 'CHANGED' else 'MATCH' end as state from documents",
    "q71_polygon_sources": "select page_id, page_id % 5 in (0, 2) as polygons from pages",
    "q72_fallback_plan": _fallback_sql(),
    "q73_fact_domains": _fact_sql(),
    "q74_compared_runs": _COMPARED,
}
