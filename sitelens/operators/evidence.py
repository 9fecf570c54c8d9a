"""Evidence records: ledger rows, contradictions, dependencies, reviews, annotation, summaries.

Everything works on many projects at once; ``project_id`` is part of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import collapsed, contains_any, folded


def ledger_rows(projects: DataFrame, id_col: str, fields: Sequence[tuple[str, str]] = K.LEDGER_FIELDS) -> DataFrame:
    """``id, field_name, category, value, state``: one row per input field (unpivot)."""
    cast = projects.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f) for f, _ in fields])
    long = cast.unpivot("id", [f for f, _ in fields], "field_name", "value")
    return long.select("id", "field_name", rules.mapped(F.col("field_name"), dict(fields)).alias("category"), "value", value_state(F.col("value")).alias("state"))


def value_state(value: Column) -> Column:
    """Blank values were not provided; the literal Unknown stays unknown; neither becomes zero."""
    return F.when(value.isNull() | (F.trim(value) == ""), "NOT_PROVIDED").when(value == "Unknown", "UNKNOWN").otherwise("PROVIDED")


def agent_state(state: Column, deterministic: Column) -> Column:
    known = state.isin("PROVIDED", "UNKNOWN", "NOT_PROVIDED", "FACT", "INTERPRETATION")
    return (
        F.when((state == "PROVIDED") & deterministic, "FACT").when(known, state).when(state == "ASSUMPTION", "PROVIDED").when(state == "MISSING_EVIDENCE", "NOT_PROVIDED").otherwise("UNKNOWN")
    )


def widened(ledger: DataFrame) -> DataFrame:
    """Ledger rows as agent records with domain, category and trust."""
    domain = rules.field_domain("field_name")
    return ledger.withColumns({"domain": domain, "record_category": rules.domain_category(domain), "created_by": F.lit("DEVELOPER_INPUT"), "source_trust": F.lit("UNVERIFIED_DEVELOPER_INPUT")})


def structured_inputs(inputs: DataFrame, json_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Developer records parsed by ``schema``, and the rows that do not parse (they become warnings)."""
    parsed = inputs.withColumn("_r", F.from_json(json_col, schema, {"mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.forall(F.array(*[F.col(f"_r.{f}").isNull() for f in parsed.schema["_r"].dataType.names]), lambda x: x)
    return parsed.where(~bad).select(*inputs.columns, "_r.*"), parsed.where(bad).drop("_r")


def missing_item(record_domain: Column, field: Column, state: Column) -> Column:
    """What an unknown record misses; null for a known one."""
    label = F.coalesce(rules.mapped(field, K.MISSING_LABELS), F.concat(record_domain, F.lit(": "), field, F.lit(" is "), state))
    return F.when(rules.is_unknown(state), label)


def contradictions(records: DataFrame) -> DataFrame:
    """``project_id, field, n_values, evidence_ids`` of scope fields with two known values or more."""
    field = folded("field_name")
    scope = field.isin(*K.SCOPE_FIELDS) | contains_any(field, ("scope", "configuration"))
    known = records.where(scope & F.col("value").isNotNull() & ~rules.is_unknown(F.col("state")))
    out = known.groupBy("project_id", field.alias("field")).agg(F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return out.where("n_values >= 2")


def dependencies(records: DataFrame) -> DataFrame:
    """``project_id, dependency_id, domain, evidence_ids`` by two rules of presence and absence per project."""
    field, value = folded("field_name"), folded(F.coalesce("value", F.lit("")))
    agreement, energised = F.contains(field, F.lit("grid_connection_agreement")), F.contains(field, F.lit("energisation"))
    renewable = F.contains(field, F.lit("renewable"))
    planned = F.contains(value, F.lit("planned_not_commissioned"))
    commissioned = F.contains(field, F.lit("commission"))
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("evidence_id"))))
    per = records.groupBy("project_id").agg(
        ids(agreement).alias("agreements"), F.bool_or(energised).alias("energised"), ids(renewable | planned).alias("plans"), F.bool_or(renewable).alias("any_renewable"),
        F.bool_or(planned).alias("any_planned"), F.bool_or(commissioned).alias("any_commissioned"),
    )
    unproven = F.col("any_planned") | (F.col("any_renewable") & ~F.col("any_commissioned"))
    made = F.array_compact(
        F.array(
            F.when((F.size("agreements") > 0) & ~F.col("energised"), F.struct(F.lit("dependency-grid-agreement-energisation").alias("id"), F.lit("GRID").alias("domain"), F.col("agreements").alias("ids"))),
            F.when((F.size("plans") > 0) & unproven, F.struct(F.lit("dependency-renewable-commissioning").alias("id"), F.lit("ENERGY").alias("domain"), F.col("plans").alias("ids"))),
        )
    )
    return per.select("project_id", F.explode(made).alias("d")).select("project_id", F.col("d.id").alias("dependency_id"), F.col("d.domain").alias("domain"), F.col("d.ids").alias("evidence_ids"))


def reviews(requests: DataFrame) -> DataFrame:
    """Requests ``(project_id, domain, reason, severity, evidence_id)`` consolidated by domain and caseless reason."""
    rank = rules.mapped(F.col("severity"), K.SEVERITY_RANK, 1)
    out = requests.groupBy("project_id", "domain", collapsed("reason").alias("reason_key")).agg(F.max(rank).alias("rank"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.count("*").alias("n_requests"))
    severity = rules.mapped(F.col("rank"), {v: k for k, v in K.SEVERITY_RANK.items()})
    return out.select("project_id", "domain", "reason_key", severity.alias("severity"), rules.review_role(F.col("domain"), "UNKNOWN").alias("role"), "evidence_ids", "n_requests")


def merged_reviews(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two review lists by id: the higher severity wins, evidence ids unite, the first role that is known stays."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    role = F.min_by("role", F.struct(F.when(F.col("role").isin("UNKNOWN", "DEVELOPER"), 1).otherwise(0), "_s"))
    return both.groupBy("review_id").agg(
        F.max_by("severity", rules.mapped(F.col("severity"), K.SEVERITY_RANK, 1)).alias("severity"),
        role.alias("role"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )


def annotated(records: DataFrame, dependency: DataFrame, contradiction: DataFrame, review: DataFrame) -> DataFrame:
    """Records with their dependency and contradiction ids and whether a review covers them."""

    def links(rows: DataFrame, value: str, name: str) -> DataFrame:
        flat = rows.select("project_id", F.explode("evidence_ids").alias("evidence_id"), F.col(value).alias("v"))
        return flat.groupBy("project_id", "evidence_id").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias(name))

    on = ["project_id", "evidence_id"]
    out = records.join(links(dependency, "dependency_id", "dependency_ids"), on, "left").join(links(contradiction, "field", "contradiction_ids"), on, "left")
    out = out.join(links(review, "role", "review_roles"), on, "left")
    return out.withColumns({"human_review_required": F.col("review_roles").isNotNull(), **{c: F.coalesce(c, F.lit("")) for c in ("dependency_ids", "contradiction_ids", "review_roles")}})


def contradiction_links(records: DataFrame) -> DataFrame:
    """``project_id, field, n_values, evidence_id``: ``contradictions`` as rows, for projects of any size.

    Values are made distinct before they are counted, and the records meet the counts by a plain join, which splits a hot field.
    """
    field = folded("field_name")
    scope = field.isin(*K.SCOPE_FIELDS) | contains_any(field, ("scope", "configuration"))
    known = records.where(scope & F.col("value").isNotNull() & ~rules.is_unknown(F.col("state"))).select("project_id", field.alias("field"), "value", "evidence_id")
    several = known.select("project_id", "field", "value").distinct().groupBy("project_id", "field").agg(F.count("*").alias("n_values")).where("n_values >= 2")
    return known.join(several, ["project_id", "field"]).select("project_id", "field", "n_values", "evidence_id").distinct()


def dependency_links(records: DataFrame) -> DataFrame:
    """``project_id, dependency_id, domain, evidence_id``: ``dependencies`` as rows; only flags are gathered for a project."""
    field, value = folded("field_name"), folded(F.coalesce("value", F.lit("")))
    marks = {
        "agreement": F.contains(field, F.lit("grid_connection_agreement")), "energised": F.contains(field, F.lit("energisation")), "renewable": F.contains(field, F.lit("renewable")),
        "planned": F.contains(value, F.lit("planned_not_commissioned")), "commissioned": F.contains(field, F.lit("commission")),
    }
    marked = records.select("project_id", "evidence_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()])
    flags = marked.groupBy("project_id").agg(*[F.bool_or(n).alias(f"any_{n}") for n in marks])
    unproven = F.col("any_planned") | (F.col("any_renewable") & ~F.col("any_commissioned"))
    rows = marked.where("agreement or renewable or planned").join(flags, "project_id")
    one = lambda c, name, domain: F.when(c, F.struct(F.lit(name).alias("dependency_id"), F.lit(domain).alias("domain")))
    made = F.array_compact(
        F.array(
            one(F.col("agreement") & ~F.col("any_energised"), "dependency-grid-agreement-energisation", "GRID"),
            one((F.col("renewable") | F.col("planned")) & unproven, "dependency-renewable-commissioning", "ENERGY"),
        )
    )
    return rows.select("project_id", "evidence_id", F.explode(made).alias("d")).select("project_id", "d.*", "evidence_id").distinct()


def review_links(requests: DataFrame) -> DataFrame:
    """``project_id, domain, reason_key, evidence_id``: what ``reviews`` lists of each review, as rows."""
    return requests.select("project_id", "domain", collapsed("reason").alias("reason_key"), "evidence_id").where("evidence_id is not null").distinct()


def domain_summary(records: DataFrame, *by: str) -> DataFrame:
    """Per domain: record count, counts per state and per source as ordered ``name=count`` texts."""

    def tally(column: str, name: str) -> DataFrame:
        n = records.groupBy(*by, "domain", column).agg(F.count("*").alias("n"))
        item = F.concat(F.col(column), F.lit("="), F.col("n").cast("string"))
        return n.groupBy(*by, "domain").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias(name), F.sum("n").alias("records"))

    return tally("state", "states").join(tally("created_by", "sources").drop("records"), [*by, "domain"])


def policy_guard(hits: DataFrame, local_authority: str | None) -> DataFrame:
    """Policy hits that may become records: current and of an admitted class, local ones of the asked authority."""
    good = (F.col("document_status") == "CURRENT") & F.col("source_class").isin("PRIMARY", "CURATED", "SUPPORTING_PUBLIC_BODY")
    local = (F.col("jurisdiction") != "LOCAL_AUTHORITY") | (folded("jurisdiction_detail") == (local_authority or "").lower())
    return hits.where(good & local)


def relevant_gaps(gaps: DataFrame) -> DataFrame:
    """Local gaps count only for planning and water."""
    return gaps.where((F.col("gap_type") != "NO_AUTHORITATIVE_LOCAL_SOURCE") | F.col("domain").isin("PLANNING", "WATER"))


def needs_human_review(reviews_: DataFrame, by: str = "project_id") -> DataFrame:
    """Workflow gate: any unresolved review holds a project back."""
    return reviews_.groupBy(by).agg(F.when(F.bool_or(F.col("status") == "REQUIRED"), "REQUIRES_HUMAN_REVIEW").otherwise("COMPLETE").alias("workflow_status"))
