"""Spatial queries: projection, overlaps, nearest, radius counts, asset filters, layer quality, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog.base import APPLICATIONS_SQL, ASSETS_SQL, FAULTY_SQL, SITES_SQL, ZONES_SQL, applications, assets, faulty_zones, sites, table, zones
from sitelens.functions import geo
from sitelens.functions.constants import GRID_TOP_K, PLANNING_TOP_K, SITE_RADII_M
from sitelens.operators import layers, repair, site_evidence, spatial


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return sites(table(spark, d, "supplier"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return zones(table(spark, d, "part"))


def _applications(spark: SparkSession, d: str) -> DataFrame:
    return applications(table(spark, d, "orders"))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return assets(table(spark, d, "customer"))


def itm_projection(spark, d):
    k = F.col("s_suppkey")
    lat, lon = F.lit(51.5) + (k * 37 % 350) / 100.0, F.lit(-10.4) + (k * 53 % 480) / 100.0
    x, y = geo.to_itm(lat, lon)
    return table(spark, d, "supplier").select(k.alias("site_id"), F.round(x, 3).alias("itm_x"), F.round(y, 3).alias("itm_y"))


def _projection_sql() -> str:
    e, radius, alpha, origin = geo._krueger()
    p = geo.ITM
    east = "eta" + "".join(f" + {a!r} * cos({2.0 * (i + 1)} * xi) * sinh({2.0 * (i + 1)} * eta)" for i, a in enumerate(alpha))
    north = "xi" + "".join(f" + {a!r} * sin({2.0 * (i + 1)} * xi) * cosh({2.0 * (i + 1)} * eta)" for i, a in enumerate(alpha))
    return (
        "with l as (select s_suppkey as site_id, radians(51.5::double + (s_suppkey * 37 % 350) / 100.0::double) as phi, radians(-10.4::double + (s_suppkey * 53 % 480) / 100.0::double - (-8.0)) as dl from supplier), "
        f"t as (select *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) as t from l), "
        "u as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1.0 + t * t)) as eta from t) "
        f"select site_id, round({p['fe']} + {p['k0'] * radius!r} * ({east}), 3) as itm_x, round({p['fn']} + {p['k0'] * radius!r} * ({north} - {origin!r}), 3) as itm_y from u"
    )


def point_in_zone(spark, d):
    return spatial.intersecting(_sites(spark, d), _zones(spark, d)).select("site_id", "feature_id", "zone_type")


_PAIR = f"s as ({SITES_SQL}), z as ({ZONES_SQL}), p as (select *, greatest(abs(x - zx) - half, 0) as dx, greatest(abs(y - zy) - half, 0) as dy from s, z), dist as (select *, sqrt(dx * dx + dy * dy) as dd from p)"


def nearest_zone(spark, d):
    return spatial.nearest_polygon(_sites(spark, d), _zones(spark, d)).select("site_id", "feature_id", F.round("distance", 3).alias("distance"))


def radius_counts(spark, d):
    return spatial.radius_counts(_sites(spark, d), _applications(spark, d), SITE_RADII_M)


_NEAR = "with s as ({sites}), f as ({features}), p as (select *, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) as distance from s, f)"
_NEAR_APPS = _NEAR.format(sites=SITES_SQL, features=APPLICATIONS_SQL)
_NEAR_ASSETS = _NEAR.format(sites=SITES_SQL, features=ASSETS_SQL)


def topk_nearby(spark, d):
    near = spatial.k_within(_sites(spark, d), _applications(spark, d), 5000.0, PLANNING_TOP_K)
    return near.select("site_id", "feature_id", "status", "rank", F.round("distance", 3).alias("distance"))


def _filtered_assets(spark, d) -> DataFrame:
    return spatial.asset_filter(_assets(spark, d), ["building", "MACHINERY", "Furniture"], 50.0)


def asset_filters(spark, d):
    near = spatial.within_radius(_sites(spark, d), _filtered_assets(spark, d), 10000.0, digits=3)
    return near.select("site_id", "feature_id", "asset_class", "kv", "distance")


_FILTERED = (
    f"{_NEAR_ASSETS}, a as (select * from p where distance <= 10000 and lower(asset_class) in ('building', 'machinery', 'furniture') and try_cast(regexp_extract(kv, '^(\\d+)', 1) as double) >= 50)"
)


def asset_groups(spark, d):
    return layers.asset_groups(spatial.k_within(_sites(spark, d), _filtered_assets(spark, d), 10000.0, GRID_TOP_K))


def multi_overlap(spark, d):
    return layers.overlaps(_sites(spark, d), _zones(spark, d))


def nearest_hidden_when_hit(spark, d):
    out = layers.hit_or_nearest(_sites(spark, d), _zones(spark, d))
    return out.select("site_id", "intersects", "nearest_feature_id", F.round("nearest_distance", 3).alias("nearest_distance"))


def layer_quality(spark, d):
    return layers.quality(_zones(spark, d), "zone_type")


def polygon_repair(spark, d):
    mended = repair.repaired(faulty_zones(table(spark, d, "part")), "feature_id")
    usable = F.col("geometry_state").isin("VALID", "REPAIRED")
    return mended.select("feature_id", "geometry_state", F.when(usable, F.size("rings")).alias("parts"), F.when(usable, F.round(geo.area(F.col("rings")), 3)).alias("area"))


def repair_record(spark, d):
    return repair.repair_quality(repair.repaired(faulty_zones(table(spark, d, "part")), "feature_id"), "zone_type", "feature_id")


def site_ledger(spark, d):
    s = _sites(spark, d)
    return site_evidence.ledger(s, _zones(spark, d), _applications(spark, d), _assets(spark, d))


_LEDGER_SQL = (
    f"with s as ({SITES_SQL}), z as ({ZONES_SQL}), f as ({APPLICATIONS_SQL}), a as ({ASSETS_SQL}), "
    "hit as (select site_id, zone_type, feature_id from s, z where abs(x - zx) <= half and abs(y - zy) <= half), "
    "kinds as (select * from (values ('biodiversity', 0), ('flood', 1), ('heritage', 2), ('ground', 3)) v(domain, k)), "
    "poly as (select s.site_id, kinds.domain, count(h.feature_id) as value from s cross join kinds left join hit h on h.site_id = s.site_id and h.feature_id % 4 = kinds.k group by all), "
    "apps as (select s.site_id, 'planning' as domain, count(f.feature_id) as value from s left join f on (fx - x) * (fx - x) + (fy - y) * (fy - y) <= 25000000 group by all), "
    "grid as (select s.site_id, 'grid' as domain, count(a.feature_id) as value from s left join a on (a.fx - x) * (a.fx - x) + (a.fy - y) * (a.fy - y) <= 100000000 group by all), "
    "non as (select site_id, d as domain, null::bigint as value from s cross join (values ('zoning'), ('water')) v(d)) "
    "select site_id, domain, 'FACT' as state, value from (select * from poly union all select * from apps union all select * from grid) union all select site_id, domain, 'UNKNOWN', value from non"
)

QUERIES = {
    "q21_itm_projection": itm_projection,
    "q22_point_in_zone": point_in_zone,
    "q23_nearest_zone": nearest_zone,
    "q24_radius_counts": radius_counts,
    "q25_topk_nearby": topk_nearby,
    "q26_asset_filters": asset_filters,
    "q27_asset_groups": asset_groups,
    "q28_multi_overlap": multi_overlap,
    "q29_nearest_hidden_when_hit": nearest_hidden_when_hit,
    "q30_layer_quality": layer_quality,
    "q31_site_ledger": site_ledger,
    "q75_polygon_repair": polygon_repair,
    "q76_repair_record": repair_record,
}

SQL = {
    "q21_itm_projection": _projection_sql(),
    "q22_point_in_zone": f"with s as ({SITES_SQL}), z as ({ZONES_SQL}) select site_id, feature_id, zone_type from s, z where abs(x - zx) <= half and abs(y - zy) <= half",
    "q23_nearest_zone": f"with {_PAIR} select site_id, arg_min(feature_id, (dd, feature_id)) as feature_id, round(min(dd), 3) as distance from dist group by site_id",
    "q24_radius_counts": f"{_NEAR_APPS} select site_id, " + ", ".join(f"count(*) filter (distance <= {r}) as n_{r // 1000}_km" for r in SITE_RADII_M) + " from p group by site_id",
    "q25_topk_nearby": f"{_NEAR_APPS}, k as (select *, row_number() over (partition by site_id order by distance, feature_id)::int as rank from p where distance <= 5000) "
    "select site_id, feature_id, status, rank, round(distance, 3) as distance from k where rank <= 10",
    "q26_asset_filters": f"{_FILTERED} select site_id, feature_id, asset_class, kv, round(distance, 3) as distance from a",
    "q27_asset_groups": f"{_FILTERED}, k as (select *, row_number() over (partition by site_id order by distance, feature_id) as rank from a) "
    "select site_id, asset_class || ' / ' || kv as asset_group, count(*) as n, string_agg(feature_id::varchar, ',' order by rank) as feature_ids from k where rank <= 30 group by all",
    "q28_multi_overlap": f"with s as ({SITES_SQL}), z as ({ZONES_SQL}), h as (select site_id, feature_id from s, z where abs(x - zx) <= half and abs(y - zy) <= half) "
    "select s.site_id, count(feature_id) as n, count(feature_id) > 1 as multiple, coalesce(string_agg(feature_id::varchar, ',' order by feature_id), '') as feature_ids from s left join h using (site_id) group by s.site_id",
    "q29_nearest_hidden_when_hit": f"with {_PAIR}, m as (select site_id, bool_or(dd = 0) as intersects, arg_min(feature_id, (dd, feature_id)) as f, min(dd) as d0 from dist group by site_id) "
    "select site_id, intersects, case when not intersects then f end as nearest_feature_id, case when not intersects then round(d0, 3) end as nearest_distance from m",
    "q30_layer_quality": f"with z as ({ZONES_SQL}) select zone_type as layer, count(*) as features, 0::bigint as empty, 0::bigint as invalid, 'Polygon' as types, "
    "min(zx - half) as xmin, min(zy - half) as ymin, max(zx + half) as xmax, max(zy + half) as ymax from z group by zone_type",
    "q31_site_ledger": _LEDGER_SQL,
    "q75_polygon_repair": f"with z as ({FAULTY_SQL}) select feature_id, geometry_state, case when geometry_state in ('VALID', 'REPAIRED') then parts end::int as parts, "
    "case when geometry_state in ('VALID', 'REPAIRED') then round(area::double, 3) end as area from z",
    "q76_repair_record": f"with z as (select *, geometry_state in ('VALID', 'REPAIRED') as usable from ({FAULTY_SQL})) select zone_type as layer, count(*) as feature_count, "
    "count(*) filter (geometry_state = 'EMPTY') as empty_geometry_count_before, count(*) filter (geometry_state in ('REPAIRED', 'UNUSABLE')) as invalid_geometry_count_before, "
    "bool_or(geometry_state in ('REPAIRED', 'UNUSABLE')) as repair_attempted, count(*) filter (geometry_state = 'REPAIRED') as repaired_geometry_count, "
    "count(*) filter (not usable) as unusable_after_repair_count, 0::bigint as invalid_geometry_count_after_repair, count(*) filter (geometry_state = 'EMPTY') as empty_geometry_count_after_repair, "
    "count(*) filter (geometry_state = 'REPAIRED' and feature_id % 6 = 4) as geometry_collection_repair_count, 0::bigint as buffer_zero_fallback_count, "
    "concat_ws(', ', case when bool_or(usable and parts > 1) and bool_or(usable and parts = 1) then 'MultiPolygon, Polygon' when bool_or(usable and parts > 1) then 'MultiPolygon' when bool_or(usable) then 'Polygon' end) as output_geometry_type_after_repair, "
    "count(*) filter (usable) as output_feature_count_after_repair, count(*) filter (not usable) as dropped_unusable_feature_count from z group by zone_type",
}
