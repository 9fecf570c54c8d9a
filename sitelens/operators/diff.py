"""Snapshot comparison: flattened inputs, identities, section diffs, domain transitions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from sitelens.functions import rules


def _canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _loaded(text: str | None) -> object:
    """A JSON text's value; integers and decimals stay apart. Null for what is no JSON."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical(items: pd.Series) -> pd.Series:
    """JSON in canonical form: keys sorted, no blanks, ``50`` and ``50.0`` different and ``5e1`` the same as ``50.0``."""
    return items.map(lambda t: None if t is None or (v := _loaded(t)) is None and t.strip() != "null" else _canonical(v))


@F.pandas_udf(MapType(StringType(), StringType()))
def fields(items: pd.Series) -> pd.Series:
    """The fields of a JSON object, each in canonical form; none for other values."""
    return items.map(lambda t: {k: _canonical(v) for k, v in found.items()} if isinstance(found := _loaded(t), dict) else {})


def _leaves(value: object, path: str) -> Iterator[dict]:
    if isinstance(value, dict) and value:
        for key, child in value.items():
            yield from _leaves(child, f"{path}.{key}" if path else key)
    elif path:
        yield {"path": path, "value": _canonical(value)}


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def _all_leaves(items: pd.Series) -> pd.Series:
    return items.map(lambda t: list(_leaves(_loaded(t), "")))


def flatten_paths(rows: DataFrame, json_col: str, *keep: str, skip: Sequence[str] = ()) -> DataFrame:
    """``path, value`` of each leaf of a JSON object; nested keys join by dots; lists and empty objects are leaves.

    ``value`` is the leaf in canonical form, so ``"50"``, ``50`` and ``50.0`` differ and a string that looks like an object stays a
    string. Keys of the top level in ``skip`` are left out. Each text is read once, whatever its depth; one that is null or no JSON has no leaves.
    """
    leaves = rows.select(*keep, F.explode(_all_leaves(F.col(json_col))).alias("_leaf")).select(*keep, "_leaf.path", "_leaf.value")
    if not skip:
        return leaves
    return leaves.where(~F.substring_index("path", ".", 1).isin(*skip))


def input_changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """``path, previous, current, change_kind`` of flattened inputs ``(keys, path, value)`` that differ; absent paths are null."""
    on = [*keys, "path"]
    joined = before.select(*on, F.col("value").alias("previous")).join(after.select(*on, F.col("value").alias("current")), on, "full")
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("previous").eqNullSafe(F.col("current"))).withColumn("change_kind", kind)


def flatten_struct(df: DataFrame, column: str) -> list[Column]:
    """Leaf columns of a struct column by dotted name."""

    def walk(kind, path: str) -> list[Column]:
        if isinstance(kind, StructType) and kind.fields:
            return [c for f in kind.fields for c in walk(f.dataType, f"{path}.{f.name}")]
        return [F.col(path).alias(path.removeprefix(f"{column}."))]

    return walk(df.schema[column].dataType, column)


def identity(stable: Column, text: Column, prefix: str, position: Column) -> Column:
    """Stable id, else a digest of the caseless text, else the position under a prefix."""
    clean = F.lower(F.trim(text))
    by_text = F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("text:"), F.substring(F.sha2(clean, 256), 1, 16)))
    return F.coalesce(F.when(stable != "", stable), by_text, F.concat(F.lit(f"{prefix}-unmatched-"), position.cast("string")))


def last_of(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with repeated identities collapse to the last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).where("_n = 1").drop("_n")


def section_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, change_kind, changed_fields`` of a full outer join; fields compare null-safely."""
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, key, "full").select(key, kind.alias("change_kind"), F.when(both, F.array_join(changed, ",")).otherwise("").alias("changed_fields"))


def diff_summary(diff: DataFrame, section: str) -> DataFrame:
    return diff.groupBy("change_kind").agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "change_kind", "n")


def group_states(findings: DataFrame, by: str) -> DataFrame:
    """Most severe state of each domain group. ``findings(<by>, domain, status)``."""
    ranked = findings.select(by, rules.domain_group(F.col("domain")).alias("domain_group"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))
    return ranked.groupBy(by, "domain_group").agg(F.max_by("status", F.struct(rules.state_priority(F.col("status")), "status")).alias("state"))


def domain_transitions(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """State of each group on both sides, absent ones not assessed, and the kind of change."""
    on = [*keys, "domain_group"]
    joined = before.select(*on, F.col("state").alias("previous")).join(after.select(*on, F.col("state").alias("current")), on, "full")
    old, new = F.coalesce("previous", F.lit("NOT_ASSESSED")), F.coalesce("current", F.lit("NOT_ASSESSED"))
    return joined.select(*on, old.alias("previous"), new.alias("current"), rules.domain_change(old, new).alias("change_kind"))
