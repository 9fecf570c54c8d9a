"""Site evidence: eight domains evaluated for many sites at once into one ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import spatial

LEDGER = ("site_id", "domain", "state", "value")


def _rows(df: DataFrame, domain: str, state: str, value) -> DataFrame:
    return df.select("site_id", F.lit(domain).alias("domain"), F.lit(state).alias("state"), value.cast("long").alias("value"))


def covering(sites: DataFrame, features: DataFrame, domain: str) -> DataFrame:
    """Count of the domain's features that cover each site, zero included."""
    return _rows(spatial.covering_counts(sites, features), domain, "FACT", F.col("n"))


def nearby(sites: DataFrame, points: DataFrame, domain: str, radius: float) -> DataFrame:
    counts = spatial.radius_counts(sites, points, (radius,))
    return _rows(counts, domain, "FACT", F.col(counts.columns[1]))


def unknown(sites: DataFrame, domain: str) -> DataFrame:
    """Domains without usable data are always reported as unknown."""
    return _rows(sites, domain, "UNKNOWN", F.lit(None))


def isolated(evaluators: dict[str, Callable[[], DataFrame]], sites: DataFrame) -> DataFrame:
    """Union of the evaluators' rows; one that fails to plan becomes ERROR rows and does not stop the others."""
    out = None
    for domain, evaluate in evaluators.items():
        try:
            rows = evaluate()
            rows.schema  # noqa: B018  resolves the plan
        except Exception:  # noqa: BLE001  a failed domain is a row, not a failed run
            rows = _rows(sites, domain, "ERROR", F.lit(None))
        rows = rows.select(*LEDGER)
        out = rows if out is None else out.unionByName(rows)
    return out


def ledger(sites: DataFrame, zones: DataFrame, applications: DataFrame, assets: DataFrame) -> DataFrame:
    """All eight domains; zone layers are told apart by ``feature_id % 4``."""
    layer = lambda k: zones.where(F.col("feature_id") % 4 == k)
    return isolated(
        {
            "biodiversity": lambda: covering(sites, layer(0), "biodiversity"),
            "flood": lambda: covering(sites, layer(1), "flood"),
            "heritage": lambda: covering(sites, layer(2), "heritage"),
            "ground": lambda: covering(sites, layer(3), "ground"),
            "planning": lambda: nearby(sites, applications, "planning", 5000.0),
            "grid": lambda: nearby(sites, assets, "grid", 10000.0),
            "zoning": lambda: unknown(sites, "zoning"),
            "water": lambda: unknown(sites, "water"),
        },
        sites,
    )


def state_counts(records: DataFrame, by: str, state: str = "state", field: str = "field_name") -> DataFrame:
    """Per group: provided, unknown and not-provided counts and the list of missing fields in order."""
    missing = F.col(state).isin("UNKNOWN", "NOT_PROVIDED")
    return records.groupBy(by).agg(
        F.count_if(F.col(state) == "PROVIDED").alias("provided"),
        F.count_if(F.col(state) == "UNKNOWN").alias("unknown"),
        F.count_if(F.col(state) == "NOT_PROVIDED").alias("not_provided"),
        F.array_join(F.array_sort(F.collect_set(F.when(missing, F.col(field)))), ",").alias("missing"),
    )
