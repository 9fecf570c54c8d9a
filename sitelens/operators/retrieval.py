"""Hybrid retrieval over policy records: fusion, groups, limits, comparison candidates, gaps, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import folded


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """``qid, id, lexical_rank, semantic_rank, fusion`` of two ranked lists (reciprocal ranks, full outer join)."""
    a = lexical.select("qid", "id", F.col("rank").alias("lexical_rank"))
    b = semantic.select("qid", "id", F.col("rank").alias("semantic_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return a.join(b, ["qid", "id"], "full").withColumn("fusion", F.round(share("lexical_rank") + share("semantic_rank"), 9))


def exact_text_dedupe(records: DataFrame, id_col: str, text: Column, source_class: Column, status: Column) -> DataFrame:
    """Of records with equal stripped text the one of best authority, then least id.

    The winner is an aggregate (``min`` of a struct), so a text held by a third of all records
    combines before the shuffle.
    """
    key = F.sha2(F.trim(text), 256)
    order = F.struct(rules.class_rank(source_class).alias("c"), rules.status_rank(status).alias("s"), F.col(id_col).alias("id"))
    best = records.select(key.alias("text_hash"), order.alias("o")).groupBy("text_hash").agg(F.min("o").alias("o"), F.count("*").alias("copies"))
    return best.select(F.col("o.id").alias(id_col), "text_hash", "copies")


def grouped_hits(hits: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Ranks hits inside their authority group, applies each group's limit, then ranks all in group order.

    ``hits(qid, id, fusion, source_class, document_status, ...)``.
    """
    group = rules.authority_group(F.col("source_class"), F.col("document_status"))
    order = rules.mapped(F.col("authority_group"), rules.GROUP_ORDER)
    out = hits.withColumn("authority_group", group)
    out = out.withColumn("group_rank", F.row_number().over(Window.partitionBy("qid", "authority_group").orderBy(F.desc("fusion"), "id")))
    out = out.where(F.col("group_rank") <= rules.mapped(F.col("authority_group"), limits, 0))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order, "group_rank")))


def comparison_candidates(grouped: DataFrame) -> DataFrame:
    """``qid, comparison_type, document_ids`` where the first three authoritative hits span documents,
    or current and historical versions were retrieved together."""
    top = grouped.where(F.col("authority_group").isin("authoritative", "historical") & (F.col("group_rank") <= 3))
    docs = top.groupBy("qid", "authority_group", "document_id").agg(F.min("group_rank").alias("at"))
    lists = docs.groupBy("qid").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("authority_group") == g, F.struct("at", "document_id")))).alias(g) for g in ("authoritative", "historical")]
    )
    ids = lambda g: F.transform(g, lambda x: x["document_id"])
    now, old = ids(F.col("authoritative")), ids(F.col("historical"))
    kinds = F.array_compact(
        F.array(
            F.when(F.size(now) > 1, F.struct(F.lit("CROSS_SOURCE_COMPARISON_CANDIDATE").alias("kind"), now.alias("ids"))),
            F.when((F.size(old) > 0) & (F.size(now) > 0), F.struct(F.lit("POLICY_VERSION_DIFFERENCE").alias("kind"), F.concat(now, old).alias("ids"))),
        )
    )
    return lists.select("qid", F.explode(kinds).alias("c")).select("qid", F.col("c.kind").alias("comparison_type"), F.col("c.ids").alias("document_ids"))


def local_source_gaps(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(qid, domain, local_authority)`` without a current primary local source in the whole index."""
    held = (
        records.where((F.col("source_class") == "PRIMARY") & (F.col("document_status") == "CURRENT") & (F.col("jurisdiction") == "LOCAL_AUTHORITY"))
        .select(folded(F.coalesce("jurisdiction_detail", F.lit(""))).alias("authority_key"), F.explode("domains").alias("domain"))
        .distinct()
    )
    asked = requests.where(F.col("local_authority").isNotNull()).withColumn("authority_key", folded("local_authority"))
    return asked.join(held, ["authority_key", "domain"], "left_anti").select("qid", "domain", "local_authority", F.lit("NO_AUTHORITATIVE_LOCAL_SOURCE").alias("gap_type"))


def authoritative_gaps(requests: DataFrame, grouped: DataFrame) -> DataFrame:
    """Requests with a domain but no authoritative hit."""
    found = grouped.where(F.col("authority_group") == "authoritative").select("qid").distinct()
    return requests.where(F.col("domain").isNotNull()).join(found, "qid", "left_anti").select("qid", "domain", "local_authority", F.lit("NO_AUTHORITATIVE_SOURCE").alias("gap_type"))


def evaluate(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per case: recall at 5 and 10 and the reciprocal rank of the first gold hit.

    ``ranked(qid, id, rank)``, ``gold(qid, id, required)``. Recall counts required ids and is 0 without any.
    """
    hits = gold.join(ranked, ["qid", "id"], "left")
    required = F.count_if("required")
    at = lambda n: F.count_if(F.col("required") & (F.col("rank") <= n))
    share = lambda n: F.when(required > 0, at(n) / required).otherwise(0.0)
    return hits.groupBy("qid").agg(
        F.round(share(5), 6).alias("recall_5"), F.round(share(10), 6).alias("recall_10"), F.round(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)), 6).alias("rr")
    )


def leakage(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: over all ``requests(qid, jurisdiction)`` the share with an authoritative hit and the shares whose results hold
    what they should not: old versions, restricted or archived sources, another jurisdiction, claims under review.

    ``results(qid, source_class, document_status, jurisdiction, review, verification_status)``.
    """
    asked = results.join(requests.select("qid", F.col("jurisdiction").alias("asked")), "qid")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    allowed = rules.jurisdiction_allowed(F.col("jurisdiction"), F.col("asked"))
    per = asked.groupBy("qid").agg(
        some((F.col("source_class") == "PRIMARY") & (F.col("document_status") == "CURRENT")).alias("authoritative_source_hit_rate"),
        some(F.col("document_status").isin("PROPOSED", "HISTORICAL", "SUPERSEDED")).alias("historical_leakage_rate"),
        some(F.col("source_class").isin("RESTRICTED", "ARCHIVE")).alias("restricted_archive_leakage_rate"),
        some(F.col("asked").isNotNull() & ~allowed).alias("jurisdiction_leakage_rate"),
        some(F.coalesce("review", F.lit(False)) | F.col("verification_status").eqNullSafe(F.lit("REVIEW_REQUIRED"))).alias("flagged_claim_leakage_rate"),
    )
    names = [c for c in per.columns if c != "qid"]
    every = requests.select("qid").distinct().join(per, "qid", "left")
    total = F.greatest(F.count("*"), F.lit(1))
    return every.agg(F.count("*").alias("cases"), *[F.round(F.count_if(F.coalesce(c, F.lit(False))) / total, 6).alias(c) for c in names])
