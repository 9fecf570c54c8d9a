"""Validators of tables, plans and registries as rows of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import collapsed


def header_check(spark: SparkSession, table_name: str, header: Sequence[str], required: Sequence[str], expected: Sequence[str] = ()) -> DataFrame:
    """One row: missing required names (case matters), missing expected ones, repeated ones, validity."""
    repeated = sorted({h for h in header if list(header).count(h) > 1})
    missing = [r for r in required if r not in header]
    absent = [e for e in expected if e not in header]
    row = (table_name, len(header), ",".join(missing), ",".join(absent), ",".join(repeated), not missing and not repeated)
    return spark.createDataFrame([row], "table_name string, columns int, missing_required string, missing_expected string, repeated string, valid boolean")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file as written, byte order mark removed."""
    import csv

    first = spark.read.text(path).head(1)
    return next(csv.reader([first[0].value.lstrip("﻿")])) if first else []


def registry_expansion(entries: DataFrame, include_ineligible: bool = False) -> DataFrame:
    """Entry times output path; only fully processed entries unless asked otherwise."""
    rows = entries if include_ineligible else entries.where(F.col("status") == "PROCESSED")
    return rows.withColumn("output_path", F.explode("output_paths")).drop("output_paths")


def registry_listing(entries: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Entries by equality on whatever filters are set."""
    out = entries
    for name, value in filters.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def processing_status(valid: Column, mode: Column, failed: Column, warnings: Column) -> Column:
    """Where an entry stands after validation and processing."""
    return (
        F.when(~valid, "VALIDATION_FAILED").when(mode == "register_only", "REGISTERED_ONLY").when(failed, "PROCESSING_FAILED").when(warnings > 0, "PROCESSED_WITH_WARNINGS").otherwise("PROCESSED")
    )


def plan_check(requests: DataFrame) -> DataFrame:
    """``plan_id, request_no, reason, keep``: the first reason against each tool request, and whether it stays.

    ``requests(plan_id, request_no, tool, domain, query)``. Of accepted requests equal in tool, domain and
    caseless query the first stays.
    """
    allowed = F.lit(False)
    for tool, domains in K.TOOL_DOMAINS.items():
        allowed = allowed | ((F.col("tool") == tool) & F.col("domain").isin(*domains))
    known = F.col("domain").isin(*K.PROJECT_TOOL_DOMAINS, "UNKNOWN")
    reason = (
        F.when(~F.coalesce(F.col("tool").isin(*K.TOOL_DOMAINS), F.lit(False)), "UNKNOWN_TOOL")
        .when(~F.coalesce(known, F.lit(False)), "UNKNOWN_DOMAIN")
        .when(~allowed, "DOMAIN_NOT_ALLOWED_FOR_TOOL")
        .otherwise(rules.query_rejection(F.col("query")))
    )
    judged = requests.select("plan_id", "request_no", "tool", "domain", collapsed("query").alias("key"), reason.alias("reason"))
    first = judged.where("reason is null").groupBy("plan_id", "tool", "domain", "key").agg(F.min("request_no").alias("request_no")).select("plan_id", "request_no", F.lit(True).alias("first"))
    return judged.join(first, ["plan_id", "request_no"], "left").select("plan_id", "request_no", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("first", F.lit(False)).alias("keep"))
