"""Whole comparison of stored runs: items of each section with fallbacks, identities, labels, inputs and counters.

A run's result is one JSON text, read once; items stay JSON in canonical form, so any field a run stored takes part. Many run
pairs are compared in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sitelens.functions import constants as K
from sitelens.operators import diff


@dataclass(frozen=True)
class Section:
    """Where a section's items are (the first place that has any counts), what names one and what to call one without a name."""

    name: str
    places: tuple[str, ...]
    id_key: str
    prefix: str
    texts: tuple[str, ...] = ()


SECTIONS = (
    Section("findings", ("$.assessment_result.findings",), "finding_id", "finding"),
    Section("unknowns", ("$.explanation_result.material_unknown_themes",), "theme_id", "unknown-theme"),
    Section("dependencies", ("$.assessment_result.dependencies", "$.evidence_bundle.dependencies", "$.explanation_result.dependencies"), "dependency_id", "dependency", ("value", "description")),
    Section("reviews", ("$.human_reviews", "$.assessment_result.human_reviews"), "review_id", "review"),
    Section("actions", ("$.explanation_result.next_action_plan", "$.explanation_result.next_actions"), "action_id", "action", ("value", "title", "rationale")),
)
#: Unknowns of a run without themes.
PLAIN_UNKNOWNS = Section("unknowns", ("$.assessment_result.material_unknowns",), "unknown_id", "unknown", ("value", "title", "summary"))
#: Lists whose items carry evidence ids besides the bundle's records.
EVIDENCE_HOLDERS = ("$.assessment_result.findings", "$.explanation_result.material_unknown_themes", "$.explanation_result.next_action_plan", "$.human_reviews")
PLAIN = "plain unknowns"
CITATIONS = ("$.explanation_result.customer_facing_citations", "$.explanation_result.source_citations")
EVIDENCE_FIELDS = ("source_document_id", "source_path", "domain", "document_status")


#: Rows of a result that are no section's items: the bundle's records, and ids of evidence that other items name.
RECORD, NAMED = "#record", "#evidence"
_ITEMS = ArrayType(StructType([StructField("section", StringType()), StructField("pos", IntegerType()), StructField("item", StringType())]))


def _list_at(result: object, place: str) -> list:
    for key in place.removeprefix("$.").split("."):
        result = result.get(key) if isinstance(result, dict) else None
    return result if isinstance(result, list) else []


def _items_of(text: str | None) -> list[dict]:
    """All that a run's result holds for a comparison, in one reading."""
    result = diff._loaded(text)
    themes = bool(_list_at(result, SECTIONS[1].places[0]))
    lists = [(s.name if s is not PLAIN_UNKNOWNS else PLAIN, s.places) for s in (*SECTIONS, *([] if themes else [PLAIN_UNKNOWNS]))]
    lists += [("citations", CITATIONS), (RECORD, ("$.evidence_bundle.records",))]
    out = []
    for section, places in lists:
        found = next((x for p in places if (x := _list_at(result, p))), [])
        # Plain values become objects of one field.
        out += [{"section": section, "pos": i, "item": diff._canonical(v if isinstance(v, dict) else {"value": v})} for i, v in enumerate(found)]
    for place in EVIDENCE_HOLDERS:
        for holder in _list_at(result, place):
            ids = holder.get("evidence_ids") if isinstance(holder, dict) else None
            out += [{"section": NAMED, "pos": 0, "item": i} for i in (ids if isinstance(ids, list) else []) if isinstance(i, str) and i]
    return out


@F.pandas_udf(_ITEMS)
def result_items(results: pd.Series) -> pd.Series:
    return results.map(_items_of)


def field(item: Column, name: str) -> Column:
    """A top-level field's trimmed text; blank and absent alike are null."""
    return F.nullif(F.trim(F.get_json_object(item, f"$.{name}")), F.lit(""))


def text_key(text: Column) -> Column:
    """Identity of an item without an id: a digest of its caseless text."""
    clean = F.lower(F.trim(text))
    return F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("text:"), F.substring(F.sha2(clean, 256), 1, 16)))


def all_items(runs: DataFrame, *keys: str, result: str = "result") -> DataFrame:
    """``keys, section, identity, matchable, item`` of all seven sections of ``runs``; of repeated identities the last counts.

    Items are known by their id, else by their text, else by their place; citations by document, else by path and locator. Evidence is
    every id that a run's bundle, findings, themes, actions or reviews name, with what the bundle's record says.
    """
    rows = runs.select(*keys, F.explode(result_items(F.col(result))).alias("_i")).select(*keys, "_i.*")
    item, section = F.col("item"), F.col("section")
    named, prefix = F.when(section == NAMED, item).when(section == RECORD, field(item, "evidence_id")), F.lit("item")
    document, path, locator = (field(item, f) for f in ("document_id", "source_path", "locator"))
    shown = lambda c: F.coalesce(c, F.lit("None"))
    named = named.when(section == "citations", F.coalesce(document, F.when(F.coalesce(path, locator).isNotNull(), text_key(F.concat(shown(path), F.lit("|"), shown(locator))))))
    for s in (*SECTIONS, PLAIN_UNKNOWNS):
        own = section == (PLAIN if s is PLAIN_UNKNOWNS else s.name)
        text = text_key(F.coalesce(*[field(item, t) for t in s.texts])) if s.texts else F.lit(None).cast("string")
        named, prefix = named.when(own, F.coalesce(field(item, s.id_key), text)), F.when(own, s.prefix).otherwise(prefix)
    nameless = F.when(section == "citations", text_key(F.lit("None|None"))).otherwise(F.concat(prefix, F.lit("-unmatched-"), F.col("pos").cast("string")))
    known = rows.withColumn("named", named).withColumn("identity", F.coalesce("named", nameless))
    evidence = section.isin(RECORD, NAMED)
    known = known.where(~evidence | F.col("named").isNotNull()).withColumn("section", F.when(evidence, "evidence").when(section == PLAIN, "unknowns").otherwise(section))
    # A record says more of its id than those that only name it.
    rank = F.struct((F.col("item") != F.col("identity")).alias("record"), "pos")
    last = known.groupBy(*keys, "section", "identity").agg(F.max_by(F.struct(F.col("named").isNotNull().alias("matchable"), "item"), rank).alias("x"))
    told = F.when(F.col("x.item") == F.col("identity"), F.lit("{}")).otherwise(F.col("x.item"))
    record = F.to_json(F.struct(F.col("identity").alias("evidence_id"), *[F.get_json_object(told, f"$.{f}").alias(f) for f in EVIDENCE_FIELDS]))
    return last.select(*keys, "section", "identity", "x.matchable", F.when(F.col("section") == "evidence", record).otherwise(F.col("x.item")).alias("item"))


def compared_items(items: DataFrame, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """``pair, section, identity, change_kind, changed_fields`` of the items of sides ``a`` and ``b``; both meet by their identity."""
    of = lambda s: F.max(F.when(F.col(side) == s, F.col("item"))).alias(s)
    joined = items.groupBy(pair, "section", "identity").agg(of("a"), of("b"))
    joined = joined.withColumns({"ma": diff.fields(F.col("a")), "mb": diff.fields(F.col("b"))})
    keys = F.array_sort(F.array_union(F.map_keys("ma"), F.map_keys("mb")))
    differ = F.filter(keys, lambda k: ~F.try_element_at("ma", k).eqNullSafe(F.try_element_at("mb", k)))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = F.when(both, differ).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return joined.select(pair, "section", "identity", kind.alias("change_kind"), F.array_join(changed, ",").alias("changed_fields"))


def input_label(path: Column) -> Column:
    """A known input's label, else its path in words."""
    spelled = F.initcap(F.replace(F.replace(path, F.lit("."), F.lit(" · ")), F.lit("_"), F.lit(" ")))
    table = F.create_map(*[F.lit(x) for kv in K.INPUT_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, path), spelled)


def input_display(path: Column, value: Column) -> Column:
    """How a report shows an input's JSON text: units, and words for what is empty."""
    plain = F.when(F.startswith(value, F.lit('"')), F.try_variant_get(F.try_parse_json(value), "$", "string"))
    shown = F.when(value == "true", "True").when(value == "false", "False").otherwise(F.coalesce(plain, value))
    out = shown
    for name, unit in K.INPUT_UNITS.items():
        out = F.when(path == name, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(value.isNull() | value.isin("null", '""'), "Unknown / Not provided").when(value == "[]", "None recorded").when(value == "{}", "Provided").otherwise(out)


def input_diff(before: DataFrame, after: DataFrame, pair: str = "pair_id", json_col: str = "context") -> DataFrame:
    """Inputs of two contexts side by side: ``pair, path, label, previous, current, previous_display, current_display, change_kind``."""
    a, b = (diff.flatten_paths(x, json_col, pair, skip=K.INPUT_SKIPPED) for x in (before, after))
    joined = a.withColumnRenamed("value", "previous").join(b.withColumnRenamed("value", "current"), [pair, "path"], "full")
    missing = lambda c: F.coalesce(F.col(c), F.lit("null"))
    return joined.select(
        pair,
        "path",
        input_label(F.col("path")).alias("label"),
        "previous",
        "current",
        input_display(F.col("path"), F.col("previous")).alias("previous_display"),
        input_display(F.col("path"), F.col("current")).alias("current_display"),
        # An absent input equals one that is null.
        F.when(missing("previous") == missing("current"), "unchanged").otherwise("changed").alias("change_kind"),
    )


#: Counters of a summary: a section's added and removed items by the names that reports use.
COUNTERS = {
    "findings": ("new", "removed"),
    "unknowns": ("new", "resolved"),
    "dependencies": ("new", "removed"),
    "reviews": ("new", "removed"),
    "actions": ("new", "removed"),
    "evidence": ("new", "removed"),
    "citations": ("new", "removed"),
}


def summary(pairs: DataFrame, items: DataFrame, inputs: DataFrame, domains: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The twenty-three counters of each pair, a column each."""
    of = lambda section, kind: F.count_if((F.col("section") == section) & (F.col("change_kind") == kind))
    counters = [
        made
        for section, (added, gone) in COUNTERS.items()
        for made in (of(section, "added").alias(f"{added}_{section}"), of(section, "removed").alias(f"{gone}_{section}"), of(section, "changed").alias(f"changed_{section}"))
    ]
    rows = (
        items.select(pair, "section", "change_kind")
        .union(inputs.select(pair, F.lit("inputs"), "change_kind"))
        .union(domains.select(pair, F.lit("domains"), F.when(F.col("change_kind") == "UNCHANGED", "unchanged").otherwise("changed")))
    )
    counted = rows.groupBy(pair).agg(of("inputs", "changed").alias("input_changes"), of("domains", "changed").alias("domain_changes"), *counters)
    names = [c for c in counted.columns if c != pair]
    return pairs.select(pair).join(counted, pair, "left").select(pair, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def comparison(pairs: DataFrame, pair: str = "pair_id") -> dict[str, DataFrame]:
    """Everything two stored runs differ in, for many pairs at once.

    ``pairs(pair_id, baseline_context, baseline_result, comparison_context, comparison_result)`` hold JSON. Returns ``items``,
    ``inputs``, ``domains`` and ``summary``.
    """
    side = lambda s, name: pairs.select(pair, F.lit(s).alias("side"), F.col(f"{name}_context").alias("context"), F.col(f"{name}_result").alias("result"))
    found = all_items(side("a", "baseline").union(side("b", "comparison")), pair, "side")
    findings = found.where("section = 'findings'").select(pair, "side", F.coalesce(field(F.col("item"), "domain"), F.lit("UNKNOWN")).alias("domain"), F.coalesce(field(F.col("item"), "status"), F.lit("UNKNOWN")).alias("status"))
    items, inputs = compared_items(found, pair), input_diff(side("a", "baseline"), side("b", "comparison"), pair)
    domains = diff.domain_transitions(*[diff.group_states(findings.where(F.col("side") == s), pair) for s in "ab"], pair)
    return {"items": items, "inputs": inputs, "domains": domains, "summary": summary(pairs, items, inputs, domains, pair)}
