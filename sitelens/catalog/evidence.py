"""Evidence, assessment and explanation queries over line items as evidence records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog.base import pick, sql_list, sql_pick, table
from sitelens.catalog.portfolio import _FINDINGS, findings
from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.operators import assessment, evidence, explanation

FIELDS = (
    "grid_connection_agreement", "planned_power_mw", "project_scope", "water_feasibility", "renewable_asset_status", "zoning_evidence",
    "biodiversity_nearest", "energisation_status", "requested_mic_mva", "site_address", "ground_conditions",
)
STATES = ("PROVIDED", "UNKNOWN", "NOT_PROVIDED", "FACT", "PROVIDED", "PROVIDED", "FACT")
CREATORS = ("DEVELOPER_INPUT", "DETERMINISTIC_GIS", "RAG_RETRIEVAL", "PROJECT_DOCUMENT", "RAG_RETRIEVAL")
CLASSES = ("PRIMARY", "CURATED", "SUPPORTING_INDUSTRY")
NOTES = (
    "no protected site was found to intersect", "nearest asset at two kilometres", "development is not permitted in this zone", "proposed substation to the north",
    "a policy interpretation by the developer", "planned renewable plant", "connection agreement signed", "water capacity is open", "mic not confirmed",
)


def records(spark: SparkSession, d: str) -> DataFrame:
    """Line items as evidence records; all columns follow the keys."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    field = pick(FIELDS, p)
    created = pick(CREATORS, p + n)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.concat_ws("-", text(p), text(s), text(n)).alias("evidence_id"),
        field.alias("field_name"),
        rules.field_domain(field).alias("domain"),
        pick(STATES, s + n).alias("state"),
        text(F.col("l_quantity").cast("int") % 3).alias("value"),
        created.alias("created_by"),
        pick(CLASSES, s).alias("source_class"),
        rules.source_trust(created, pick(CLASSES, s)).alias("source_trust"),
        F.when(s % 4 > 0, "CURRENT").otherwise("PROPOSED").alias("document_status"),
        pick(NOTES, p + s).alias("note"),
    )


_DOMAIN = "case " + " ".join(f"when starts_with(field_name, '{x}') then '{y}'" for x, y in K.FIELD_DOMAINS) + f" when field_name in {K.ENERGY_FIELDS} then 'ENERGY' else 'GENERAL' end"
_TRUST = (
    "case when created_by = 'RAG_RETRIEVAL' and source_class in ('PRIMARY', 'CURATED') then 'AUTHORITATIVE_POLICY' when created_by = 'RAG_RETRIEVAL' then 'SUPPORTING_SOURCE' when created_by = 'DETERMINISTIC_GIS' then 'DETERMINISTIC_SOURCE' "
    "when created_by = 'DEVELOPER_INPUT' then 'UNVERIFIED_DEVELOPER_INPUT' else 'UNTRUSTED_PROJECT_DOCUMENT' end"
)
_RECORDS = (
    f"r0 as (select l_orderkey as project_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber as evidence_id, {sql_pick(FIELDS, 'l_partkey')} as field_name, {sql_pick(STATES, 'l_suppkey + l_linenumber')} as state, "
    f"(trunc(l_quantity)::int % 3)::varchar as value, {sql_pick(CREATORS, 'l_partkey + l_linenumber')} as created_by, {sql_pick(CLASSES, 'l_suppkey')} as source_class, "
    f"case when l_suppkey % 4 > 0 then 'CURRENT' else 'PROPOSED' end as document_status, {sql_pick(NOTES, 'l_partkey + l_suppkey')} as note from lineitem), "
    f"r as (select *, {_DOMAIN} as domain, {_TRUST} as source_trust from r0)"
)


def _projects(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    return table(spark, d, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("project_name"),
        F.col("c_mktsegment").alias("development_type"),
        F.when(k % 3 == 0, "Unknown").otherwise("Feasibility").alias("project_stage"),
        F.when(k % 4 > 0, F.concat(F.lit("Site "), k.cast("string"))).otherwise("  ").alias("site_address"),
        F.when(k % 2 == 0, (k % 90).cast("int")).alias("latitude"),
        F.when(k % 2 == 0, (k % 180).cast("int")).alias("longitude"),
        F.when(k % 5 == 0, null).otherwise((k % 40).cast("string")).alias("site_area_hectares"),
        F.col("c_nationkey").alias("planned_power_demand_mw"),
        F.when(k % 7 == 0, "Unknown").alias("requested_mic_mva"),
        F.when(k % 6 == 1, "Grid").otherwise("Unknown").alias("power_strategy"),
        null.alias("energy_strategy"),
        F.lit("").alias("project_phasing_notes"),
    )


def ledger_unpivot(spark, d):
    return evidence.ledger_rows(_projects(spark, d), "id")


_CATEGORY = "case field_name " + " ".join(f"when '{f}' then '{c}'" for f, c in K.LEDGER_FIELDS) + " end"
_LEDGER = (
    "with p as (select c_custkey as id, c_name as project_name, c_mktsegment as development_type, case when c_custkey % 3 = 0 then 'Unknown' else 'Feasibility' end as project_stage, "
    "case when c_custkey % 4 > 0 then 'Site ' || c_custkey else '  ' end as site_address, case when c_custkey % 2 = 0 then (c_custkey % 90)::varchar end as latitude, case when c_custkey % 2 = 0 then (c_custkey % 180)::varchar end as longitude, "
    "case when c_custkey % 5 = 0 then null else (c_custkey % 40)::varchar end as site_area_hectares, c_nationkey::varchar as planned_power_demand_mw, case when c_custkey % 7 = 0 then 'Unknown' end as requested_mic_mva, "
    "case when c_custkey % 6 = 1 then 'Grid' else 'Unknown' end as power_strategy, null::varchar as energy_strategy, '' as project_phasing_notes from customer), "
    "u as (" + " union all ".join(f"select id, '{f}' as field_name, {f} as value from p" for f, _ in K.LEDGER_FIELDS) + ") "
    f"select id, field_name, {_CATEGORY} as category, value, case when value is null or trim(value) = '' then 'NOT_PROVIDED' when value = 'Unknown' then 'UNKNOWN' else 'PROVIDED' end as state from u"
)


def state_counts(spark, d):
    from sitelens.operators.site_evidence import state_counts as counts

    return counts(records(spark, d), "project_id")


def domain_summary(spark, d):
    return evidence.domain_summary(records(spark, d).withColumn("group_id", F.col("project_id") % 100), "group_id")


def contradictions(spark, d):
    out = evidence.contradictions(records(spark, d))
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def dependencies(spark, d):
    return evidence.dependencies(records(spark, d)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def _requests(spark, d) -> DataFrame:
    r = records(spark, d).where("state = 'UNKNOWN'")
    severity = F.when(F.col("domain") == "GRID", "HIGH_CONSEQUENCE").when(F.col("source_class") == "CURATED", "INFORMATIONAL").otherwise("MATERIAL")
    padded = F.when(F.col("value") == "1", F.upper(F.concat(F.lit("  "), F.replace("note", F.lit(" "), F.lit("  "))))).otherwise(F.col("note"))
    return r.select("project_id", "domain", padded.alias("reason"), severity.alias("severity"), "evidence_id")


def review_consolidation(spark, d):
    return evidence.reviews(_requests(spark, d)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_ROLE = "case domain " + " ".join(f"when '{k}' then '{v}'" for k, v in K.REVIEW_ROLES.items()) + " else 'UNKNOWN' end"
_REVIEWS = (
    "q as (select project_id, domain, lower(note) as reason_key, case when domain = 'GRID' then 2 when source_class = 'CURATED' then 0 else 1 end as sev, evidence_id from r where state = 'UNKNOWN'), "
    "rv as (select project_id, domain, reason_key, max(sev) as sev, list_sort(list(distinct evidence_id)) as ids, count(*) as n_requests from q group by all)"
)
_CONTRADICTIONS = (
    "cd as (select project_id, field_name as field, count(distinct value) as n_values, list_sort(list(distinct evidence_id)) as ids from r where (field_name in "
    f"{K.SCOPE_FIELDS} or contains(field_name, 'scope') or contains(field_name, 'configuration')) and state not in ('UNKNOWN', 'NOT_PROVIDED') group by all having count(distinct value) >= 2)"
)
_DEPENDENCIES = (
    "pr as (select project_id, list_sort(list(distinct evidence_id) filter (contains(field_name, 'grid_connection_agreement'))) as ag, bool_or(contains(field_name, 'energisation')) as en, "
    "list_sort(list(distinct evidence_id) filter (contains(field_name, 'renewable'))) as rn from r group by project_id), "
    "dp as (select project_id, 'dependency-grid-agreement-energisation' as dependency_id, 'GRID' as domain, ag as ids from pr where len(ag) > 0 and not en "
    "union all select project_id, 'dependency-renewable-commissioning', 'ENERGY', rn from pr where len(rn) > 0)"
)


def record_annotation(spark, d):
    r = records(spark, d)
    out = evidence.annotated(r.select("project_id", "evidence_id").distinct(), evidence.dependencies(r), evidence.contradictions(r), evidence.reviews(_requests(spark, d)))
    return out.select("project_id", "evidence_id", "dependency_ids", "contradiction_ids", "review_roles", "human_review_required")


def keyword_domain(spark, d):
    docs = table(spark, d, "documents")
    phrase = pick(NOTES, F.col("doc_id"))
    return docs.select("doc_id", rules.keyword_domain(phrase).alias("note_domain"), rules.keyword_domain("text").alias("text_domain"))


def _keyword_sql(text: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains({text}, '{k}')" for k in K.DOMAIN_KEYWORDS[x]) + f" then '{x}'" for x in K.DOMAIN_ORDER)
    return f"case {cases} else 'GENERAL' end"


def _assessable(spark, d) -> DataFrame:
    r = records(spark, d)
    cols = {c: F.col(c) for c in ("created_by", "source_trust", "source_class", "document_status")} | {"deterministic": F.lit(False)}
    return r.select(
        "project_id",
        "domain",
        "evidence_id",
        "state",
        F.concat_ws(" ", "field_name", "note").alias("text"),
        rules.is_authoritative(cols).alias("authoritative"),
        rules.is_deterministic(cols).alias("deterministic"),
        rules.is_project_document(cols).alias("project_document"),
    )


def assessment_findings(spark, d):
    out = assessment.findings(_assessable(spark, d))
    return out.withColumn("evidence_ids", F.array_join(F.array_sort("evidence_ids"), ",")).drop("rule_order")


def _assessment_sql() -> str:
    any_of = lambda terms: "(" + " or ".join(f"contains(text, '{x}')" for x in terms) + ")"
    ids = lambda cond: f"list_sort(list(distinct evidence_id) filter ({cond}))"
    some = lambda c: f"len(coalesce({c}, [])) > 0"
    unknown = "state in ('UNKNOWN', 'NOT_PROVIDED')"
    material = f"case when {any_of(K.GRID_ISSUE_TERMS)} then true " + " ".join(f"when domain = '{x}' then {any_of(t)}" for x, t in K.MATERIAL_TERMS.items()) + " else false end"
    energised = any_of(("energisation", "energization"))
    planned = "(contains(text, 'planned_not_commissioned') or (contains(text, 'planned') and contains(text, 'renewable')))"
    ready = "('GRID', 'PLANNING', 'WATER', 'BIODIVERSITY', 'ENVIRONMENT')"
    rule = lambda name, cond, status, own, review: f"select project_id, domain, '{name}' as rule, '{status}' as status, {own} as ids, {review} as human_review_required from h where not {some('ex')} and {cond}"
    merged = lambda a, b: f"list_sort(list_distinct(list_concat(coalesce({a}, []), coalesce({b}, []))))"
    middle = [
        rule("grid_context", f"domain = 'GRID' and {some('cx')}", "CONDITIONAL", "cx", "true"),
        rule("grid_agreement", f"domain = 'GRID' and {some('ag')} and not energised", "CONDITIONAL", merged("ag", "eg"), "true"),
        rule("grid_proposed", "domain = 'GRID' and proposed", "CONDITIONAL", "al", "true"),
        rule("water_feasibility", "domain = 'WATER' and feasibility and not secured", "CONDITIONAL", "al", "true"),
        rule("energy_planned", "domain = 'ENERGY' and planned", "CONDITIONAL", "al", "true"),
        rule("no_intersection", f"domain in ('BIODIVERSITY', 'ENVIRONMENT') and {some('ci')}", "CONDITIONAL", "ci", "true"),
        rule("policy_interpretation", some("pi"), "CONDITIONAL", merged("pi", "au"), "true"),
        rule("unknown", some("un"), "UNKNOWN", "un", "(grid_issue or material)"),
    ]
    docs = f"({some('dc')} and not {some('au')} and not anydet)"
    quiet = "not exists (select 1 from mid where mid.project_id = h.project_id and mid.domain = h.domain)"
    last = [
        rule("document_only", f"{quiet} and {docs}", "CONDITIONAL", "dc", "true"),
        rule("evidence_only", f"{quiet} and not {docs} and domain in {ready}", "CONDITIONAL", "al", "false"),
        rule("clear", f"{quiet} and not {docs} and domain not in {ready}", "CLEAR", "al", "false"),
    ]
    return (
        f"with {_RECORDS}, a as (select project_id, domain, evidence_id, state, field_name || ' ' || note as text, created_by = 'RAG_RETRIEVAL' and source_trust = 'AUTHORITATIVE_POLICY' and document_status = 'CURRENT' as authoritative, "
        "created_by = 'DETERMINISTIC_GIS' as deterministic, created_by = 'PROJECT_DOCUMENT' as pdoc from r), "
        f"h as (select project_id, domain, {ids('true')} as al, {ids(unknown)} as un, {ids(f'not ({unknown}) and (authoritative or deterministic) and ' + any_of(K.CONSTRAINT_TERMS))} as ex, {ids('pdoc')} as dc, {ids('authoritative')} as au, "
        f"bool_or(deterministic) as anydet, {ids('deterministic and ' + any_of(('nearest', 'asset', 'capacity', 'connection')))} as cx, {ids(any_of(('agreement',)))} as ag, {ids(energised)} as eg, bool_or({energised} and not ({unknown})) as energised, "
        f"bool_or({any_of(('proposed substation', 'planned substation', 'proposed connection'))}) as proposed, bool_or(contains(text, 'feasibility')) as feasibility, bool_or({any_of(('connection agreement', 'secured connection', 'operational connection'))}) as secured, "
        rf"bool_or({planned}) as planned, {ids(chr(39).join(('regexp_matches(text, ', K.NO_INTERSECTION_PATTERN, ')')))} as ci, {ids('pdoc and ' + any_of(K.POLICY_INTERPRETATION_TERMS))} as pi, "
        f"bool_or({unknown} and {any_of(K.GRID_ISSUE_TERMS)}) as grid_issue, bool_or({material}) as material from a group by all), "
        f"mid as ({' union all '.join(middle)}), every as (select project_id, domain, 'explicit_constraint' as rule, 'CONSTRAINED' as status, ex as ids, true as human_review_required from h where {some('ex')} "
        f"union all select * from mid union all {' union all '.join(last)}) select project_id, domain, rule, status, array_to_string(ids, ',') as evidence_ids, human_review_required from every"
    )


def theme_rollup(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    unknowns = docs.select((i % 10).alias("project_id"), i.alias("item_id"), pick((*NOTES, "other question"), i).alias("text"), pick(K.DOMAIN_ORDER, i).alias("domain"))
    out = explanation.themes(unknowns).withColumn("domains", F.array_join("domains", ","))
    acts = explanation.actions(unknowns).select("project_id", F.col("action").alias("theme"), F.lit(None).cast("string").alias("domains"), "n", "first_item", F.lit(None).cast("long").alias("last_item"))
    return out.withColumn("kind", F.lit("theme")).unionByName(acts.withColumn("kind", F.lit("action")))


def _theme_sql(rules_: tuple, text: str) -> str:
    any_of = lambda terms: " or ".join(f"contains({text}, '{x}')" for x in terms)
    return f"case when {any_of(('water', 'wastewater'))} then 'water-connection-readiness' " + " ".join(f"when {any_of(terms)} then '{key}'" for key, terms in rules_)


_ITEMS = f"it as (select doc_id % 10 as project_id, doc_id as item_id, {sql_pick((*NOTES, 'other question'), 'doc_id')} as text, {sql_pick(K.DOMAIN_ORDER, 'doc_id')} as domain from documents)"


def citations_top3(spark, d):
    docs = table(spark, d, "documents")
    made = docs.select(F.col("doc_id").alias("evidence_id"), F.concat("source", F.lit(" "), "lang").alias("citation"))
    marked = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    items = marked.join(docs.select("doc_id"), "doc_id").groupBy((F.col("doc_id") % 20).alias("item_id"), "quality").agg(F.array_sort(F.collect_set("doc_id")).alias("evidence_ids"))
    items = items.select(F.concat_ws("-", F.col("item_id").cast("string"), F.col("quality").cast("string")).alias("item_id"), "evidence_ids")
    return explanation.citations(items, made).select("item_id", "citation", "rank")


def result_summary(spark, d):
    f = findings(spark, d)
    s = explanation.source_counts(records(spark, d).withColumn("run_id", F.col("project_id")), "run_id")
    wide = s.select("run_id", F.array_join(F.array_sort(F.transform("sources", lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string")))), ",").alias("sources"))
    return explanation.result_summary(f, "run_id").join(wide, "run_id")


_LABEL = "case when created_by = 'RAG_RETRIEVAL' and source_class in ('PRIMARY', 'CURATED') then 'Authoritative Policy' " + " ".join(f"when created_by = '{k}' then '{v}'" for k, v in K.SOURCE_LABELS.items()) + " else 'Supporting Policy' end"
_LABELS = (*dict.fromkeys(K.SOURCE_LABELS.values()), "Authoritative Policy")

QUERIES = {
    "q50_ledger_unpivot": ledger_unpivot,
    "q51_state_counts": state_counts,
    "q52_domain_summary": domain_summary,
    "q53_contradictions": contradictions,
    "q54_dependencies": dependencies,
    "q55_review_consolidation": review_consolidation,
    "q56_record_annotation": record_annotation,
    "q57_keyword_domain": keyword_domain,
    "q58_assessment_findings": assessment_findings,
    "q59_theme_rollup": theme_rollup,
    "q60_citations_top3": citations_top3,
    "q66_result_summary": result_summary,
}

SQL = {
    "q50_ledger_unpivot": _LEDGER,
    "q51_state_counts": f"with {_RECORDS} select project_id, count(*) filter (state = 'PROVIDED') as provided, count(*) filter (state = 'UNKNOWN') as unknown, count(*) filter (state = 'NOT_PROVIDED') as not_provided, "
    "coalesce(array_to_string(list_sort(list(distinct field_name) filter (state in ('UNKNOWN', 'NOT_PROVIDED'))), ','), '') as missing from r group by project_id",
    "q52_domain_summary": f"with {_RECORDS}, g as (select *, project_id % 100 as group_id from r), s as (select group_id, domain, state || '=' || count(*) as x, count(*) as n from g group by group_id, domain, state), "
    "c as (select group_id, domain, created_by || '=' || count(*) as x from g group by group_id, domain, created_by), "
    "s2 as (select group_id, domain, string_agg(x, ',' order by x) as states, sum(n)::bigint as records from s group by all), c2 as (select group_id, domain, string_agg(x, ',' order by x) as sources from c group by all) select * from s2 join c2 using (group_id, domain)",
    "q53_contradictions": f"with {_RECORDS}, {_CONTRADICTIONS} select project_id, field, n_values, array_to_string(ids, ',') as evidence_ids from cd",
    "q54_dependencies": f"with {_RECORDS}, {_DEPENDENCIES} select project_id, dependency_id, domain, array_to_string(ids, ',') as evidence_ids from dp",
    "q55_review_consolidation": f"with {_RECORDS}, {_REVIEWS} select project_id, domain, reason_key, case sev when 2 then 'HIGH_CONSEQUENCE' when 1 then 'MATERIAL' else 'INFORMATIONAL' end as severity, {_ROLE} as role, array_to_string(ids, ',') as evidence_ids, n_requests from rv",
    "q56_record_annotation": f"with {_RECORDS}, {_REVIEWS}, {_CONTRADICTIONS}, {_DEPENDENCIES}, e as (select distinct project_id, evidence_id from r), "
    "l1 as (select project_id, evidence_id, string_agg(distinct dependency_id, ',' order by dependency_id) as v from (select project_id, unnest(ids) as evidence_id, dependency_id from dp) group by all), "
    "l2 as (select project_id, evidence_id, string_agg(distinct field, ',' order by field) as v from (select project_id, unnest(ids) as evidence_id, field from cd) group by all), "
    f"l3 as (select project_id, evidence_id, string_agg(distinct role, ',' order by role) as v from (select project_id, unnest(ids) as evidence_id, {_ROLE} as role from rv) group by all) "
    "select e.project_id, e.evidence_id, coalesce(l1.v, '') as dependency_ids, coalesce(l2.v, '') as contradiction_ids, coalesce(l3.v, '') as review_roles, l3.v is not null as human_review_required "
    "from e left join l1 using (project_id, evidence_id) left join l2 using (project_id, evidence_id) left join l3 using (project_id, evidence_id)",
    "q57_keyword_domain": f"with b as (select doc_id, {sql_pick(NOTES, 'doc_id')} as note, replace(lower(text), 'ß', 'ss') as low from documents) select doc_id, {_keyword_sql('note')} as note_domain, {_keyword_sql('low')} as text_domain from b",
    "q58_assessment_findings": _assessment_sql(),
    "q59_theme_rollup": f"with {_ITEMS}, th as (select *, {_theme_sql(K.THEME_TERMS, 'text')} " + " ".join(f"when domain = '{k}' then '{v}'" for k, v in K.THEME_OF_DOMAIN.items()) + " else 'other-material-unknown' end as theme, "
    f"{_theme_sql(K.ACTION_TERMS, 'text')} else 'action:' || text end as act from it) "
    "select project_id, theme, array_to_string(list_sort(list(distinct domain)), ',') as domains, count(*) as n, min(item_id) as first_item, max(item_id) as last_item, 'theme' as kind from th group by project_id, theme "
    "union all select project_id, act, null, count(*), min(item_id), null, 'action' from th group by project_id, act",
    "q60_citations_top3": "with m as (select doc_id, max(quality) as quality from labels group by doc_id), i as (select (doc_id % 20) || '-' || quality as item_id, doc_id, source || ' ' || lang as citation from m join documents using (doc_id)), "
    "o as (select item_id, citation, min(doc_id) as pos from i group by all), k as (select *, row_number() over (partition by item_id order by pos, citation)::int as rank from o) select item_id, citation, rank from k where rank <= 3",
    "q66_result_summary": f"with {_RECORDS}, f as ({_FINDINGS}), s as (select run_id, count(*) as findings, count(*) filter (status = 'CLEAR') as clear, count(*) filter (status = 'UNKNOWN') as unknown, "
    f"count(*) filter (status = 'CONDITIONAL') as conditional, count(*) filter (status = 'CONSTRAINED') as constrained from f group by run_id), l as (select project_id as run_id, {_LABEL} as label from r), "
    f"e as (select distinct run_id, unnest({sql_list(_LABELS)}) as label from l), c as (select e.run_id, e.label || '=' || count(l.label) as x from e left join l on l.run_id = e.run_id and l.label = e.label group by e.run_id, e.label), "
    "w as (select run_id, string_agg(x, ',' order by x) as sources from c group by run_id) select s.*, sources from s join w using (run_id)",
}
