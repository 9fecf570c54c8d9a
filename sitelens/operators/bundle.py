"""Evidence bundles: records of policy hits, project facts and project chunks, united with all others; fallback plans; wording."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import contains_any, redacted_paths
from sitelens.operators import evidence

#: Columns of a record; bundles hold the sources in this order.
RECORD = (
    "project_id", "evidence_id", "domain", "category", "field_name", "fact", "source_name", "source_reference", "source_class", "document_status", "state", "confidence", "verification_status",
    "limitation", "human_review_required", "human_review_role", "created_by", "source_trust",
)
SOURCES = ("developer", "gis", "policy", "project")


def first_hits(hits: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ("project_id", "record_key")) -> DataFrame:
    """Of hits on one record by several queries, the first in ``order`` (an aggregate, so a popular record combines before the shuffle)."""
    rest = [c for c in hits.columns if c not in by]
    best = hits.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*by, "x.*")


def _record(rows: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    return rows.select(*[made[c].alias(c) for c in RECORD])


def policy_records(hits: DataFrame) -> DataFrame:
    """Records of ``hits(project_id, record_key, domain, title, document_id, issuer, source_path, text, source_class, document_status, verification_status, review)``."""
    domain, kind = F.col("domain"), F.coalesce("source_class", F.lit("UNKNOWN"))
    status = F.coalesce("document_status", F.lit("UNKNOWN"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("document_id").cast("string"), F.lit("Retrieved policy source"))
    issuer = F.trim(F.coalesce("issuer", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    path = F.coalesce("source_path", F.lit(""))
    supporting = F.when(~kind.isin("PRIMARY", "CURATED"), K.SUPPORTING_LIMITATION)
    return _record(
        hits,
        {
            "project_id": F.col("project_id"),
            "evidence_id": F.concat(F.lit("rag-"), "record_key"),
            "domain": domain,
            "category": rules.domain_category(domain),
            "field_name": F.concat(F.lit("policy."), F.lower(domain)),
            "fact": F.when(text != "", text).otherwise(F.concat(F.lit("Retrieved evidence from "), title)),
            "source_name": F.when(issuer != "", F.concat(issuer, F.lit(" — "), title)).otherwise(title),
            "source_reference": F.when(path != "", F.concat(redacted_paths(path), F.lit("::"), "record_key")).otherwise(F.col("record_key")),
            "source_class": kind,
            "document_status": status,
            "state": F.lit("PROVIDED"),
            "confidence": F.when(kind == "PRIMARY", "HIGH").otherwise("MEDIUM"),
            "verification_status": F.coalesce("verification_status", F.lit("UNVERIFIED")),
            "limitation": F.when(status != "CURRENT", K.NOT_CURRENT_LIMITATION).otherwise(supporting),
            "human_review_required": F.coalesce("review", F.lit(False)),
            "human_review_role": rules.review_role(domain),
            "created_by": F.lit("RAG_RETRIEVAL"),
            "source_trust": rules.source_trust(F.lit("RAG_RETRIEVAL"), kind),
        },
    )


def fact_domain(field: Column) -> Column:
    """Domain of a project fact by words in its name, first hit first."""
    out = F.lit("GENERAL")
    for words, domain in reversed(K.FACT_DOMAINS):
        out = F.when(contains_any(F.lower(field), words), domain).otherwise(out)
    return out


def _project(rows: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    domain = made["domain"]
    return _record(
        rows,
        {
            "project_id": F.col("project_id"),
            "category": rules.domain_category(domain),
            "source_name": F.concat(F.lit("PROJECT DOCUMENT — "), "project_document_id"),
            "source_reference": F.concat(redacted_paths("source_url"), F.lit("::"), "locator"),
            "source_class": F.lit("UNKNOWN"),
            "document_status": F.lit("SUPPORTING"),
            "confidence": F.lit("UNKNOWN"),
            "verification_status": F.lit("UNVERIFIED_PROJECT_DOCUMENT"),
            "limitation": F.lit(K.PROJECT_LIMITATION),
            "human_review_required": F.lit(True),
            "human_review_role": rules.review_role(domain),
            "created_by": F.lit("PROJECT_DOCUMENT"),
            "source_trust": F.lit("UNTRUSTED_PROJECT_DOCUMENT"),
            **made,
        },
    )


def project_fact_records(facts: DataFrame) -> DataFrame:
    """Records of ``facts(project_id, fact_id, project_document_id, field_name, value, status, benchmark_only, source_url, locator)``; ``value`` is JSON text."""
    value = F.concat(F.lit('{"benchmark_only": '), F.col("benchmark_only").cast("string"), F.lit(', "status": "'), "status", F.lit('", "value": '), F.coalesce("value", F.lit("null")), F.lit("}"))
    return _project(
        facts,
        {
            "evidence_id": F.concat(F.lit("project-fact-"), "fact_id"),
            "domain": fact_domain(F.col("field_name")),
            "field_name": F.concat(F.lit("project."), "field_name"),
            "fact": F.concat("field_name", F.lit(": "), value),
            "state": F.when(F.col("value").isNotNull(), "PROVIDED").otherwise("UNKNOWN"),
        },
    )


def project_chunk_records(chunks: DataFrame) -> DataFrame:
    """Records of ``chunks(project_id, chunk_id, project_document_id, domain, text, source_url, locator)``."""
    domain = F.coalesce("domain", F.lit("UNKNOWN"))
    return _project(
        chunks,
        {
            "evidence_id": F.concat(F.lit("project-chunk-"), "chunk_id"),
            "domain": domain,
            "field_name": F.concat(F.lit("project_document."), F.lower(domain)),
            "fact": F.col("text"),
            "state": F.lit("PROVIDED"),
        },
    )


def united(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Records of all sources with ``source_order``: developer, site, policy, project."""
    out = None
    for name, rows in parts.items():
        own = rows.select(*RECORD, F.lit(SOURCES.index(name)).alias("source_order"))
        out = own if out is None else out.unionByName(own)
    return out


def assemble(parts: Mapping[str, DataFrame], gaps: DataFrame) -> dict[str, DataFrame]:
    """A bundle for each project: ``records``, distinct ``missing`` items (those of records and ``gaps(project_id, item)``),
    ``contradictions`` and ``dependencies``, all tables by ``project_id``."""
    records = united(parts)
    item = evidence.missing_item(F.col("domain"), F.col("field_name"), F.col("state"))
    missing = records.select("project_id", item.alias("item")).where("item is not null").unionByName(gaps.select("project_id", "item")).distinct()
    valued = records.withColumn("value", F.col("fact"))
    return {"records": records, "missing": missing, "contradictions": evidence.contradictions(valued), "dependencies": evidence.dependencies(valued)}


def fallback_plan(projects: DataFrame, with_documents: Column) -> DataFrame:
    """``project_id, position, tool, domain, query, priority, required`` of the broad plan that stands in for a planner."""
    one = lambda tool, domain, query, priority, required=False: F.struct(F.lit(tool).alias("tool"), F.lit(domain).alias("domain"), F.lit(query).alias("query"), F.lit(priority).alias("priority"), F.lit(required).alias("required"))
    rows = [one("POLICY_RAG_SEARCH", d, f"Identify current authoritative {d.lower()} policy evidence relevant to this project.", "HIGH" if d in ("GRID", "PLANNING") else "MEDIUM") for d in K.PLAN_POLICY_DOMAINS]
    rows += [one("GIS_SITE_EVIDENCE", d, f"Run deterministic site evidence for {d.lower()} where the submitted location supports it.", "MEDIUM") for d in K.PLAN_SITE_DOMAINS]
    rows.append(one("DEVELOPER_INPUT_EVIDENCE", "GENERAL", "Preserve structured developer input evidence and unknown values.", "HIGH", True))
    documents = one("PROJECT_DOCUMENT_SEARCH", "GENERAL", K.PLAN_DOCUMENT_QUERY, "MEDIUM")
    every = F.when(with_documents, F.array(*rows, documents)).otherwise(F.array(*rows))
    return projects.select("project_id", F.posexplode(every).alias("position", "r")).select("project_id", "position", "r.*")


def finding_text(f: Mapping[str, Column], assessor: str = "The assessment") -> Column:
    """A finding in words: status, domain, detail, what would resolve it, its id and evidence. ``assessor`` names who looked."""
    listed = lambda c: F.array_join(F.array_distinct(c), "; ")
    or_else = lambda c, words: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(words) if isinstance(words, str) else words)
    status, domain = f["status"], f["domain"]
    dash = lambda word, detail: F.concat(F.lit(f"{word} — "), domain, F.lit(": "), detail)
    unknowns = or_else(listed(f["unknowns"]), F.concat(domain, F.lit(K.UNKNOWN_DETAIL)))
    text = (
        F.when(status == "CONSTRAINED", dash("CONSTRAINED", or_else(f["constraint"], K.CONSTRAINED_TEXT)))
        .when(status == "CONDITIONAL", dash("CONDITIONAL", or_else(f["impact"], K.CONDITIONAL_TEXT)))
        .when(status == "UNKNOWN", dash("UNKNOWN", F.concat(F.lit(assessor + K.UNKNOWN_TEXT), unknowns, F.lit("."))))
        .when(status == "CLEAR", dash("CLEAR", or_else(f["impact"], K.CLEAR_TEXT)))
        .otherwise(F.concat(F.coalesce(F.nullif(status, F.lit("")), F.lit("NOT_ASSESSED")), F.lit(" — "), domain, F.lit(K.UNRESOLVED_TEXT)))
    )
    more = F.when(F.size(f["required_next"]) > 0, F.concat(F.lit(K.RESOLVING_TEXT), listed(f["required_next"]), F.lit("."))).otherwise("")
    ids = F.when(F.size(f["evidence_ids"]) > 0, F.concat(F.lit(" [evidence: "), F.array_join(F.array_distinct(f["evidence_ids"]), ", "), F.lit("]"))).otherwise("")
    return F.concat(text, more, F.lit(" [finding: "), f["finding_id"], F.lit("]"), ids)
