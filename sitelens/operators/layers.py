"""Layer operators: quality, repair subset, standardisation, per-site roll-ups, nearest with source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import spatial


def resolve_columns(available: Sequence[str], wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Actual spellings of the wanted names, without repeats, and the names that are missing (caseless)."""
    actual = {}
    for c in available:
        actual.setdefault(c.lower(), c)
    found = list(dict.fromkeys(actual[w.lower()] for w in wanted if w.lower() in actual))
    return found, [w for w in wanted if w.lower() not in actual]


def project(layer: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist; a missing required column raises. What is not listed (personal data) goes."""
    missing = resolve_columns(layer.columns, required)[1]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return layer.select(*resolve_columns(layer.columns, wanted)[0])


def coordinate_filter(rows: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Rows with numeric coordinates inside the ranges, as ``x`` and ``y``; others drop."""
    cx, cy = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    return rows.withColumns({"x": cx, "y": cy}).where(F.col("x").between(*x_range) & F.col("y").between(*y_range))


def quality(layer: DataFrame, by: str, rings: str = "rings") -> DataFrame:
    """Per layer: feature, empty and invalid counts, types and bounds.

    A ring that begins inside another is a hole of it and makes no further part.
    """
    x1, y1, x2, y2 = geo.bounds(F.col(rings))
    empty = F.coalesce(F.size(rings) == 0, F.lit(True))
    kind = F.when(F.size(rings) == 0, None).when(geo.outer_rings(F.col(rings)) == 1, "Polygon").otherwise("MultiPolygon")
    return layer.groupBy(F.col(by).alias("layer")).agg(
        F.count("*").alias("features"),
        F.count_if(empty).alias("empty"),
        F.count_if(~empty & ~geo.is_valid_ring_set(F.col(rings))).alias("invalid"),
        F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("types"),
        F.min(x1).alias("xmin"),
        F.min(y1).alias("ymin"),
        F.max(x2).alias("xmax"),
        F.max(y2).alias("ymax"),
    )


def usable(layer: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds ``geometry_state`` (VALID, EMPTY or INVALID); only valid features take part in site queries.

    Rings that are not closed are closed first. Invalid polygons are rebuilt by ``repair.repaired``.
    """
    shut = F.transform(rings, lambda r: F.when((F.size(r) >= 3) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.array(F.element_at(r, 1)))).otherwise(r))
    closed = layer.withColumn(rings, F.when(F.size(rings) > 0, shut).otherwise(F.col(rings)))
    state = F.when(F.coalesce(F.size(rings) == 0, F.lit(True)), "EMPTY").when(geo.is_valid_ring_set(F.col(rings)), "VALID").otherwise("INVALID")
    return closed.withColumn("geometry_state", state)


def to_itm_layer(layer: DataFrame, rings: str = "rings") -> DataFrame:
    """Vertices from WGS84 degrees (x longitude, y latitude) to Irish transverse Mercator metres."""

    def move(p: Column) -> Column:
        x, y = geo.to_itm(p["y"], p["x"])
        return geo.point(x, y)

    return layer.withColumn(rings, F.transform(rings, lambda r: F.transform(r, move)))


def duplicate_key_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows share their key with another."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def asset_groups(ranked: DataFrame) -> DataFrame:
    """Assets already limited to the nearest, grouped by class and rating."""
    name = F.concat(F.col("asset_class"), F.lit(" / "), F.col("kv"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature_id"))), lambda x: x["feature_id"].cast("string"))
    return ranked.groupBy("site_id", name.alias("asset_group")).agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("feature_ids"))


def overlaps(sites: DataFrame, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per site all covering features and whether there are several; other columns of ``sites`` named in ``keep`` stay."""
    return spatial.covering_ids(sites, features).select("site_id", "n", (F.col("n") > 1).alias("multiple"), "feature_ids", *keep)


def hit_or_nearest(sites: DataFrame, features: DataFrame) -> DataFrame:
    """Whether a layer covers each site, and the nearest feature only where it does not."""
    near = spatial.nearest_polygon(sites, features)
    hit = F.coalesce(F.col("distance") == 0, F.lit(False))
    return sites.select("site_id").join(near, "site_id", "left").select(
        "site_id", hit.alias("intersects"), F.when(~hit, F.col("feature_id")).alias("nearest_feature_id"), F.when(~hit, F.col("distance")).alias("nearest_distance")
    )


def preferred_references(references: DataFrame, marker: str) -> DataFrame:
    """References whose path or layer holds the marker; onshore ones where there are any, else all."""
    held = references.where(F.contains(F.lower("path"), F.lit(marker)) | F.contains(F.lower("layer"), F.lit(marker)))
    from pyspark.sql import Window

    onshore = F.contains(F.lower("path"), F.lit("onshore"))
    any_onshore = F.max(onshore).over(Window.partitionBy("domain"))
    return held.withColumn("_any", any_onshore).where(~F.col("_any") | onshore).drop("_any")


def with_source_layer(nearest: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance by caseless layer name, else that of the default source, else null; every row comes back once.

    Of several sources of one layer name, or several defaults, the least provenance counts.
    """
    named = sources.groupBy(F.lower("layer").alias("_key")).agg(F.min("provenance").alias("_own"))
    default = sources.where("is_default").agg(F.min("provenance")).scalar()
    joined = nearest.withColumn("_key", F.lower("source_layer")).join(named, "_key", "left")
    return joined.withColumn("provenance", F.coalesce("_own", default)).select(*nearest.columns, "provenance")


def flood_identity(zip_name: Column, layer: Column) -> tuple[Column, Column]:
    """Flood type of a zip's name and return period at the end of a layer's."""
    kind = F.when(F.contains(F.lower(zip_name), F.lit("_c_")) | F.contains(F.lower(zip_name), F.lit("coastal")), "coastal").otherwise("fluvial")
    return kind, F.nullif(F.regexp_extract(layer, r"_(\d{4})$", 1), F.lit(""))


def json_safe(value: Column, kind: str) -> Column:
    """NaN to null, dates and timestamps to ISO text."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if kind == "timestamp":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    return value
