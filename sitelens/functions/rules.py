"""Rule ladders as Column expressions: ranks, eligibility, domains, roles, themes and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions.text import collapsed, column, contains_any, folded


def mapped(value: Column, table: Mapping, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(default))


def class_rank(source_class: Column | str) -> Column:
    return mapped(column(source_class), K.CLASS_RANK, K.OTHER_RANK)


def status_rank(status: Column | str) -> Column:
    return mapped(column(status), K.STATUS_RANK, K.OTHER_RANK)


def is_governance_query(query: Column, domains: Column) -> Column:
    return F.array_contains(domains, "RESPONSIBLE_AI") | F.rlike(F.lower(query), F.lit(K.GOVERNANCE_PATTERN))


def local_authority_of(query: Column, given: Column) -> Column:
    """The authority asked for, else the one the query's places imply."""
    out = F.when(given.isNotNull() & (given != ""), given)
    for name, pattern in K.LOCAL_AUTHORITY_PATTERNS:
        out = out.when(F.rlike(F.lower(query), F.lit(pattern)), name)
    return out


def jurisdiction_allowed(actual: Column, requested: Column) -> Column:
    return F.when(requested.isNull(), F.lit(True)).when(requested == "IRELAND", actual.isin(*K.IRELAND_SCOPE)).otherwise(actual == requested)


def class_allowed(source_class: Column, status: Column, review: Column, legal: Column, governance: Column, historical: Column, supporting: Column) -> Column:
    """The part of the eligibility rule that looks at class and status."""
    return (
        F.when(source_class.isin("RESTRICTED", "ARCHIVE"), F.lit(False))
        .when(source_class == "GOVERNANCE", governance)
        .when((source_class == "PRIMARY") & (status == "CURRENT"), ~review)
        .when(source_class == "PRIMARY", status.isin("PROPOSED", "HISTORICAL", "SUPERSEDED") & historical)
        .when(source_class == "CURATED", ~F.coalesce(legal.isin("proposal_or_consultation", "needs_source_review"), F.lit(False)))
        .when(source_class == "SUPPORTING_PUBLIC_BODY", F.lit(True))
        .when(source_class.isin("SUPPORTING_INDUSTRY", "SUPPORTING_RESEARCH"), supporting)
        .otherwise(F.lit(False))
    )


def eligible(r: Mapping[str, Column], q: Mapping[str, Column]) -> Column:
    """The whole eligibility predicate of a record ``r`` for a request ``q``.

    Record keys: eligible, source_class, status, review, legal_status, jurisdiction, detail,
    workflows, domains. Request keys: governance, include_historical, include_supporting, jurisdiction,
    local_authority, workflow, domains, legal_status, review_required. Empty arrays and nulls pass.
    """
    local = q["local_authority"].isNull() | (r["jurisdiction"] != "LOCAL_AUTHORITY") | (folded(F.coalesce(r["detail"], F.lit(""))) == folded(q["local_authority"]))
    flow = (
        q["workflow"].isNull()
        | (F.size(r["workflows"]) == 0)
        | F.array_contains(r["workflows"], q["workflow"])
        | F.array_contains(r["workflows"], F.lit("POLICY_REGULATORY_INTELLIGENCE"))
    )
    domains = (F.size(q["domains"]) == 0) | (F.size(r["domains"]) == 0) | F.arrays_overlap(r["domains"], q["domains"])
    legal_of = F.coalesce(r["legal_status"], mapped(r["status"], K.LEGAL_STATUS_OF_DOCUMENT), r["status"])
    legal = (F.size(q["legal_status"]) == 0) | F.array_contains(q["legal_status"], legal_of)
    reviewed = F.coalesce(q["review_required"], F.lit(True)) | ~r["review"]
    kind = class_allowed(r["source_class"], r["status"], r["review"], r["legal_status"], q["governance"], q["include_historical"], q["include_supporting"])
    return F.coalesce(r["eligible"] & kind & jurisdiction_allowed(r["jurisdiction"], q["jurisdiction"]) & local & flow & domains & legal & reviewed, F.lit(False))


def authority_group(source_class: Column, status: Column) -> Column:
    return (
        F.when((source_class == "PRIMARY") & (status == "CURRENT"), "authoritative")
        .when(source_class == "PRIMARY", "historical")
        .when(source_class == "CURATED", "curated")
        .otherwise("supporting")
    )


GROUP_ORDER = {"authoritative": 0, "historical": 1, "curated": 2, "supporting": 3}


def keyword_domain(text: Column | str) -> Column:
    """First domain, in rule order, with a keyword in the text."""
    low = folded(text)
    out = None
    for domain in K.DOMAIN_ORDER:
        hit = contains_any(low, K.DOMAIN_KEYWORDS[domain])
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("GENERAL")


def mentions_domain(domain: str, text: Column) -> Column:
    return contains_any(folded(text), K.DOMAIN_KEYWORDS[domain])


def domain_rank(domain: Column) -> Column:
    return mapped(domain, {d: i for i, d in enumerate(K.DOMAIN_ORDER)}, len(K.DOMAIN_ORDER))


def field_domain(field: Column | str) -> Column:
    low = folded(field)
    out = None
    for prefix, domain in K.FIELD_DOMAINS:
        hit = F.startswith(low, F.lit(prefix))
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.when(low.isin(*K.ENERGY_FIELDS), "ENERGY").otherwise("GENERAL")


def domain_category(domain: Column) -> Column:
    return F.when(domain.isin("GRID", "ENERGY"), "POWER_AND_ENERGY").when(domain.isin("PLANNING", "BIODIVERSITY", "ENVIRONMENT", "WATER"), "SITE").otherwise("OTHER")


def review_role(domain: Column, default: str = "DEVELOPER") -> Column:
    return mapped(domain, K.REVIEW_ROLES, default)


def review_role_for_issue(domain: Column, text: Column) -> Column:
    return F.when(contains_any(folded(text), K.GRID_ISSUE_TERMS), "GRID_ENGINEER").otherwise(review_role(domain))


def review_issue(domain: Column, text: Column) -> tuple[Column, Column]:
    """Domain alias and issue key that consolidate reviews of one underlying question."""
    low = collapsed(text)
    grid = contains_any(low, (*K.GRID_ISSUE_TERMS, "grid readiness", "grid asset"))
    energy = contains_any(low, ("renewable", "commissioned", "commissioning"))
    planning = contains_any(low, ("zoning", "local-authority planning", "local planning", "development-plan", "development plan"))
    water = contains_any(low, ("water", "wastewater"))
    document = contains_any(low, ("project-document", "project document", "non-authoritative"))
    conflict = contains_any(low, ("conflicting evidence", "scope mismatch")) | (F.contains(low, F.lit("scope")) & F.contains(low, F.lit("confirm")))
    alias = F.when(grid, "GRID").when(energy, "ENERGY").when(planning, "PLANNING").when(water, "WATER").otherwise(domain)
    issue = (
        F.when(grid, "grid-connection-readiness")
        .when(energy, "renewable-commissioning")
        .when(planning, "planning-evidence")
        .when(water, "water-connection-readiness")
        .when(document, "project-document-verification")
        .when(conflict, "contradiction")
        .otherwise(low)
    )
    return alias, issue


def unknown_needs_review(domain: Column, text: Column) -> Column:
    low = folded(text)
    out = F.when(contains_any(low, K.GRID_ISSUE_TERMS), F.lit(True))
    for d, terms in K.MATERIAL_TERMS.items():
        out = out.when(domain == d, contains_any(low, terms))
    return out.otherwise(F.lit(False))


def _ladder(low: Column, rules: Sequence) -> Column:
    out = F.when(contains_any(low, ("water", "wastewater")), "water-connection-readiness")
    for key, terms in rules:
        out = out.when(contains_any(low, terms), key)
    return out


def theme_key(text: Column | str, domain: Column) -> Column:
    out = _ladder(collapsed(text), K.THEME_TERMS)
    for d, key in K.THEME_OF_DOMAIN.items():
        out = out.when(F.upper(domain) == d, key)
    return out.otherwise("other-material-unknown")


def action_key(text: Column | str) -> Column:
    low = collapsed(text)
    return _ladder(low, K.ACTION_TERMS).otherwise(F.concat(F.lit("action:"), low))


def finding_priority(status: Column, contradiction: Column, has_dependency: Column) -> Column:
    return F.when(status == "CONSTRAINED", 0).when(contradiction, 1).when(has_dependency, 2).when(status == "UNKNOWN", 3).when(status == "CONDITIONAL", 4).otherwise(5)


def is_unknown(state: Column) -> Column:
    return state.isin("UNKNOWN", "NOT_PROVIDED")


def is_authoritative(r: Mapping[str, Column]) -> Column:
    return (r["created_by"] == "RAG_RETRIEVAL") & (r["source_trust"] == "AUTHORITATIVE_POLICY") & r["source_class"].isin("PRIMARY", "CURATED") & (r["document_status"] == "CURRENT")


def is_deterministic(r: Mapping[str, Column]) -> Column:
    return (r["created_by"] == "DETERMINISTIC_GIS") | F.coalesce(r["deterministic"], F.lit(False)) | (r["source_trust"] == "DETERMINISTIC_SOURCE")


def is_project_document(r: Mapping[str, Column]) -> Column:
    return (r["created_by"] == "PROJECT_DOCUMENT") | (r["source_trust"] == "UNTRUSTED_PROJECT_DOCUMENT")


def source_trust(created_by: Column, source_class: Column) -> Column:
    return (
        F.when((created_by == "RAG_RETRIEVAL") & source_class.isin("PRIMARY", "CURATED"), "AUTHORITATIVE_POLICY")
        .when(created_by == "RAG_RETRIEVAL", "SUPPORTING_SOURCE")
        .when(created_by == "DETERMINISTIC_GIS", "DETERMINISTIC_SOURCE")
        .when(created_by == "DEVELOPER_INPUT", "UNVERIFIED_DEVELOPER_INPUT")
        .when(created_by == "PROJECT_DOCUMENT", "UNTRUSTED_PROJECT_DOCUMENT")
        .otherwise("UNKNOWN")
    )


def customer_source_label(created_by: Column, source_class: Column) -> Column:
    policy = (created_by == "RAG_RETRIEVAL") & source_class.isin("PRIMARY", "CURATED")
    return F.when(policy, "Authoritative Policy").otherwise(mapped(created_by, K.SOURCE_LABELS, "Supporting Policy"))


def explanation_source_label(r: Mapping[str, Column]) -> Column:
    policy = (r["source_trust"] == "AUTHORITATIVE_POLICY") | ((r["created_by"] == "RAG_RETRIEVAL") & r["source_class"].isin("PRIMARY", "CURATED") & (r["document_status"] == "CURRENT"))
    return (
        F.when(policy, "AUTHORITATIVE POLICY")
        .when(r["created_by"] == "DETERMINISTIC_GIS", "DETERMINISTIC GIS")
        .when(r["source_trust"] == "DETERMINISTIC_SOURCE", "DETERMINISTIC SOURCE")
        .when(r["created_by"] == "PROJECT_DOCUMENT", "PROJECT DOCUMENT (UNVERIFIED)")
        .when(r["created_by"] == "DEVELOPER_INPUT", "DEVELOPER-PROVIDED INPUT")
        .when(r["source_trust"] == "SUPPORTING_SOURCE", "SUPPORTING SOURCE")
        .otherwise("SOURCE TYPE UNKNOWN")
    )


def domain_group(domain: Column) -> Column:
    out = None
    for key, members in K.DOMAIN_GROUPS:
        hit = domain.isin(*members)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise(F.lower(domain))


def state_priority(state: Column) -> Column:
    return mapped(state, K.STATE_PRIORITY, K.STATE_PRIORITY["UNKNOWN"])


def domain_change(before: Column, after: Column) -> Column:
    return (
        F.when(before == after, "UNCHANGED")
        .when((before == "NOT_ASSESSED") & after.isin("CONDITIONAL", "CONSTRAINED"), "NEW_CONSTRAINT")
        .when(before == "NOT_ASSESSED", "NEW_DOMAIN")
        .when(after == "NOT_ASSESSED", "NO_LONGER_PRESENT")
        .otherwise("CHANGED")
    )


def query_rejection(query: Column) -> Column:
    """Reason code of an unsafe query text, null for a safe one."""
    text = F.trim(query)
    return (
        F.when(query.isNull() | (text == ""), "UNSAFE_QUERY")
        .when(F.rlike(text, F.lit(K.URL_PATTERN)), "URL_NOT_ALLOWED")
        .when(F.length(text) > K.MAX_QUERY_CHARS, "QUERY_TOO_LARGE")
        .when(F.rlike(text, F.lit(K.OVERRIDE_PATTERN)), "RULE_OVERRIDE_NOT_ALLOWED")
        .when(F.rlike(text, F.lit(K.PROMPT_PATTERN)), "SYSTEM_PROMPT_MODIFICATION")
        .when(F.rlike(text, F.lit(K.CONTROL_PATTERN)), "UNSAFE_QUERY")
    )
