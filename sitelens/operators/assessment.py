"""Assessment findings: the domain rules as one aggregate per project and domain, then rule rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import contains_any

#: Rules in the order in which their findings are issued.
RULES = (
    "explicit_constraint",
    "grid_context",
    "grid_agreement",
    "grid_proposed",
    "water_feasibility",
    "energy_planned",
    "no_intersection",
    "policy_interpretation",
    "unknown",
    "document_only",
    "evidence_only",
    "clear",
)
READINESS_DOMAINS = ("GRID", "PLANNING", "WATER", "BIODIVERSITY", "ENVIRONMENT")


def _held(records: DataFrame) -> DataFrame:
    """Per project and domain the facts that the rules ask for, in one pass.

    ``records(project_id, domain, evidence_id, state, text, authoritative, deterministic, project_document)``;
    ``text`` is the record's caseless text.
    """
    text = F.col("text")
    unknown = rules.is_unknown(F.col("state"))
    energised = contains_any(text, K.ENERGISATION_TERMS)
    planned = contains_any(text, (K.PLANNED_ENERGY_TERM,)) | (contains_any(text, (K.PLANNED_TERM,)) & contains_any(text, (K.RENEWABLE_TERM,)))
    sets = {
        "all_ids": F.lit(True),
        "unknown_ids": unknown,
        "explicit_ids": ~unknown & (F.col("authoritative") | F.col("deterministic")) & contains_any(text, K.CONSTRAINT_TERMS),
        "document_ids": F.col("project_document"),
        "authoritative_ids": F.col("authoritative"),
        "context_ids": F.col("deterministic") & contains_any(text, K.GRID_CONTEXT_TERMS),
        "agreement_ids": contains_any(text, K.AGREEMENT_TERMS),
        "energisation_ids": energised,
        "clear_of_ids": F.rlike(text, F.lit(K.NO_INTERSECTION_PATTERN)),
        "interpretation_ids": F.col("project_document") & contains_any(text, K.POLICY_INTERPRETATION_TERMS),
    }
    # One set of ids, each with the sets that it belongs to as bits.
    bits = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    member = reduce(lambda a, b: a.bitwiseOR(b), [bits(c, i) for i, c in enumerate(sets.values())])
    held = records.groupBy("project_id", "domain").agg(
        F.collect_set(F.when(F.col("evidence_id").isNotNull(), F.struct(F.col("evidence_id").alias("id"), member.alias("sets")))).alias("_ids"),
        F.bool_or(F.col("deterministic")).alias("any_deterministic"),
        F.bool_or(energised & ~unknown).alias("energised"),
        F.bool_or(contains_any(text, K.PROPOSED_GRID_TERMS)).alias("proposed"),
        F.bool_or(contains_any(text, K.FEASIBILITY_TERMS)).alias("feasibility"),
        F.bool_or(contains_any(text, K.SECURED_GRID_TERMS)).alias("secured"),
        F.bool_or(planned).alias("planned"),
        F.bool_or(unknown & contains_any(text, K.GRID_ISSUE_TERMS)).alias("grid_issue"),
        F.bool_or(rules.unknown_needs_review(F.col("domain"), text)).alias("material"),
    )
    # Sorted once, and taken apart through a generator, so the optimizer cannot copy the lists into each rule.
    ids = lambda i: F.array_distinct(F.transform(F.filter("_ids", lambda x: x["sets"].bitwiseAND(F.lit(1 << i)) != 0), lambda x: x["id"]))
    held = held.select(*[c for c in held.columns if c != "_ids"], F.explode(F.array(F.sort_array("_ids"))).alias("_ids"))
    return held.select(*[c for c in held.columns if c != "_ids"], F.inline(F.array(F.struct(*[ids(i).alias(name) for i, name in enumerate(sets)]))))


def findings(records: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``project_id, domain, rule, rule_order, status, evidence_ids, human_review_required``.

    An explicit constraint ends a domain's assessment. ``items(project_id, domain)`` are missing
    items and gaps by domain: they alone make a domain unknown even without records.
    """
    held = _held(records)
    if items is not None:
        asked = items.groupBy("project_id", "domain").agg(F.count("*").alias("n_items"))
        held = held.join(asked, ["project_id", "domain"], "full")
        arrays = [c for c, k in held.dtypes if k.startswith("array")]
        held = held.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays})
        held = held.withColumns({c: F.coalesce(c, F.lit(False)) for c, k in held.dtypes if k == "boolean"})
    else:
        held = held.withColumn("n_items", F.lit(0))
    some = lambda c: F.size(c) > 0
    domain = F.col("domain")
    unknown = some("unknown_ids") | (F.coalesce("n_items", F.lit(0)) > 0)
    union = lambda *c: F.array_distinct(F.concat(*c))

    def made(rule: str, when: Column, status: str, ids: Column, review) -> Column:
        review = F.lit(review) if isinstance(review, bool) else review
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(RULES.index(rule)).alias("rule_order"), F.lit(status).alias("status"), ids.alias("evidence_ids"), review.alias("review")))

    middle = [
        made("grid_context", (domain == "GRID") & some("context_ids"), "CONDITIONAL", F.col("context_ids"), True),
        made("grid_agreement", (domain == "GRID") & some("agreement_ids") & ~F.col("energised"), "CONDITIONAL", union("agreement_ids", "energisation_ids"), True),
        made("grid_proposed", (domain == "GRID") & F.col("proposed"), "CONDITIONAL", F.col("all_ids"), True),
        made("water_feasibility", (domain == "WATER") & F.col("feasibility") & ~F.col("secured"), "CONDITIONAL", F.col("all_ids"), True),
        made("energy_planned", (domain == "ENERGY") & F.col("planned"), "CONDITIONAL", F.col("all_ids"), True),
        made("no_intersection", domain.isin("BIODIVERSITY", "ENVIRONMENT") & some("clear_of_ids"), "CONDITIONAL", F.col("clear_of_ids"), True),
        made("policy_interpretation", some("interpretation_ids"), "CONDITIONAL", union("interpretation_ids", "authoritative_ids"), True),
        made("unknown", unknown, "UNKNOWN", F.col("unknown_ids"), F.col("grid_issue") | F.col("material")),
    ]
    ruled = F.array_compact(F.array(*middle))
    # Only where no rule spoke: documents alone, evidence alone, or nothing against.
    documents_only = some("document_ids") & ~some("authoritative_ids") & ~F.col("any_deterministic")
    last = F.array(
        made("document_only", documents_only, "CONDITIONAL", F.col("document_ids"), True),
        made("evidence_only", ~documents_only & domain.isin(*READINESS_DOMAINS), "CONDITIONAL", F.col("all_ids"), False),
        made("clear", ~documents_only & ~domain.isin(*READINESS_DOMAINS), "CLEAR", F.col("all_ids"), False),
    )
    explicit = F.array(made("explicit_constraint", F.lit(True), "CONSTRAINED", F.col("explicit_ids"), True))
    issued = F.when(some("explicit_ids"), explicit).when(F.size(ruled) > 0, ruled).when(some("all_ids"), F.array_compact(last))
    out = held.select("project_id", "domain", F.explode(issued).alias("f"))
    return out.select("project_id", "domain", F.col("f.rule").alias("rule"), F.col("f.rule_order").alias("rule_order"), F.col("f.status").alias("status"), F.col("f.evidence_ids").alias("evidence_ids"), F.col("f.review").alias("human_review_required"))


def numbered(found: DataFrame) -> DataFrame:
    """Adds ``finding_id`` by emission order: domains in rule order, rules inside."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("project_id").orderBy(rules.domain_rank(F.col("domain")), "rule_order"))
    return found.withColumn("finding_id", F.concat(F.lit("assessment-"), F.lower("domain"), F.lit("-"), n.cast("string")))


def review_requests(found: DataFrame) -> DataFrame:
    """Reviews that findings ask for, consolidated by domain alias, role and issue."""
    text = F.col("rule")
    alias, issue = rules.review_issue(F.col("domain"), F.replace(text, F.lit("_"), F.lit(" ")))
    rows = found.where("human_review_required").select("project_id", alias.alias("domain"), rules.review_role_for_issue(F.col("domain"), text).alias("role"), issue.alias("issue"), "evidence_ids")
    return rows.groupBy("project_id", "domain", "role", "issue").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
