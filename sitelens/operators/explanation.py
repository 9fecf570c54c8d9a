"""Explanations: themes, actions, citations, summaries of findings and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules

CITATIONS_PER_ITEM = 3


def themes(unknowns: DataFrame) -> DataFrame:
    """``unknowns(project_id, item_id, text, domain)`` rolled up by theme: count, domains, items in order."""
    rows = unknowns.withColumn("theme", rules.theme_key("text", F.col("domain")))
    return rows.groupBy("project_id", "theme").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("domain")).alias("domains"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item")
    )


def actions(requests: DataFrame) -> DataFrame:
    """``requests(project_id, item_id, text)`` rolled up by action key."""
    return requests.groupBy("project_id", rules.action_key("text").alias("action")).agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def action_reviews(action_rows: DataFrame, review_rows: DataFrame) -> DataFrame:
    """Actions with the reviews of equal key or of overlapping evidence: two equi joins, united and distinct."""
    on_key = action_rows.join(review_rows, (action_rows["project_id"] == review_rows["project_id"]) & (action_rows["action"] == review_rows["issue"])).select(action_rows["project_id"], "action", "review_id")
    a = action_rows.select("project_id", "action", F.explode("evidence_ids").alias("evidence_id"))
    r = review_rows.select("project_id", "review_id", F.explode("evidence_ids").alias("evidence_id"))
    return on_key.unionByName(a.join(r, ["project_id", "evidence_id"]).select("project_id", "action", "review_id")).distinct()


def citations(items: DataFrame, records: DataFrame, limit: int = CITATIONS_PER_ITEM) -> DataFrame:
    """The first ``limit`` distinct citations of each item, in order of its evidence ids.

    ``items(item_id, evidence_ids)``, ``records(evidence_id, citation)``.
    """
    flat = items.select("item_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    found = flat.join(records, "evidence_id").groupBy("item_id", "citation").agg(F.min("pos").alias("pos"))
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("pos", "citation"))
    return found.withColumn("rank", n).where(F.col("rank") <= limit)


def priority_order(found: DataFrame) -> DataFrame:
    """Findings in the order in which they are explained."""
    p = rules.finding_priority(F.col("status"), F.col("is_contradiction"), F.size("dependency_ids") > 0)
    return found.withColumn("priority", p).withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy("priority", "finding_order")))


def source_counts(records: DataFrame, by: str) -> DataFrame:
    """``by, sources``: an array of ``label, n`` with all customer-facing labels, zeros included. Labels are a fixed short table."""
    labels = (*dict.fromkeys(K.SOURCE_LABELS.values()), "Authoritative Policy")
    label = rules.customer_source_label(F.col("created_by"), F.col("source_class"))
    counted = records.select(by, label.alias("_label")).groupBy(by).agg(*[F.count_if(F.col("_label") == x).alias(f"_n{i}") for i, x in enumerate(labels)])
    return counted.select(by, F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_n{i}").alias("n")) for i, x in enumerate(labels)]).alias("sources"))


def source_summary(records: DataFrame, by: str) -> DataFrame:
    """``by, label, n``: the rows of :func:`source_counts`."""
    return source_counts(records, by).select(by, F.inline("sources"))


def result_summary(found: DataFrame, by: str) -> DataFrame:
    """Per run: findings, counts by status, reviews."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return found.groupBy(by).agg(F.count("*").alias("findings"), *[count(s) for s in ("CLEAR", "UNKNOWN", "CONDITIONAL", "CONSTRAINED")])
