"""Metadata of a document from its path: jurisdiction, domains, workflows, type and title."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions.text import contains_any


def enum_value(value: Column, allowed: Sequence[str], default: str) -> Column:
    """The value if it is one of the allowed ones, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def enum_list(values: Column, allowed: Sequence[str]) -> Column:
    """The allowed ones of a list, in order; a null list is empty."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isin(*allowed))


def jurisdiction(path: Column, configured: Column) -> Column:
    """A configured jurisdiction wins; else folders of the path name it."""
    known = enum_value(configured, K.JURISDICTIONS, "UNKNOWN")
    low = F.lower(path)
    framed = F.concat(F.lit("/"), low, F.lit("/"))
    inferred = F.lit(None).cast("string")
    for name, plain, in_frame in reversed(K.JURISDICTION_PATHS):
        hit = contains_any(low, plain) if plain else F.lit(False)
        hit = hit | contains_any(framed, in_frame) if in_frame else hit
        inferred = F.when(hit, name).otherwise(inferred)
    return F.when(known != "UNKNOWN", known).otherwise(F.coalesce(inferred, F.lit("UNKNOWN")))


def jurisdiction_detail(path: Column, found: Column, configured: Column) -> Column:
    named = F.when((found == "LOCAL_AUTHORITY") & F.contains(F.lower(path), F.lit("fingal")), "Fingal").when(found == "IRELAND", "Ireland").when(found == "EU", "European Union")
    return F.coalesce(F.nullif(configured, F.lit("")), named)


def domains(path: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """Distinct domains of all path segments in ``mapping`` that occur, in its order; without any, unknown."""
    low = F.lower(path)
    none = F.array().cast("array<string>")
    parts = [F.when(F.contains(low, F.lit(segment.lower())), F.array(*[F.lit(v) for v in values])).otherwise(none) for segment, values in mapping.items()]
    parts.append(F.when(contains_any(low, K.REPORTING_PATHS), F.array(F.lit("EU_REPORTING"))).otherwise(none))
    found = F.array_distinct(enum_list(F.flatten(F.array(*parts)), K.DOMAINS))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNKNOWN")))


def workflows(found_domains: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """Distinct workflows of the domains, in order."""
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(found_domains, lambda d: F.coalesce(F.try_element_at(table, d), none))))


def document_type(path: Column) -> Column:
    """By suffix and, for JSON, by the end of the name; else by folder."""
    low = F.lower(path)
    out = F.lit("POLICY_OR_RESEARCH_DOCUMENT")
    for words, name in reversed(K.TYPE_PATHS):
        out = F.when(contains_any(low, words), name).otherwise(out)
    for suffix, default in reversed(K.TYPE_SUFFIXES):
        named = F.lit(default)
        for end, name in reversed(K.TYPE_NAMES):
            if end.endswith(suffix):
                named = F.when(F.endswith(low, F.lit(end)), name).otherwise(named)
        out = F.when(F.endswith(low, F.lit(suffix)), named).otherwise(out)
    return out


def title(path: Column) -> Column:
    """The file's name without its last suffix, underscores as spaces."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" "))
