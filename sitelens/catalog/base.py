"""Stand-ins of the engine's inputs over the driver's tables, in Spark and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("PLANNING", "GRID", "ENERGY", "WATER", "BIODIVERSITY", "ENVIRONMENT", "DATA_CENTRE_POLICY")
STATUSES = ("PROPOSED", "HISTORICAL", "SUPERSEDED", "SUPPORTING", "CURRENT", "CURRENT", "CURRENT", "CURRENT", "CURRENT", "CURRENT", "CURRENT")
CLASSES = ("PRIMARY", "PRIMARY", "PRIMARY", "CURATED", "SUPPORTING_PUBLIC_BODY", "SUPPORTING_INDUSTRY", "SUPPORTING_RESEARCH", "ARCHIVE", "RESTRICTED", "GOVERNANCE")
JURISDICTIONS = ("LOCAL_AUTHORITY", "EU", "IRELAND", "IRELAND", "IRELAND")
DETAILS = ("Fingal", "European Union", "Ireland", "Ireland", "Ireland")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, key: Column) -> Column:
    """``values[key % len(values)]``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def sql_list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_pick(values: tuple, key: str) -> str:
    return f"{sql_list(values)}[(({key}) % {len(values)}) + 1]"


def policy_records(docs: DataFrame) -> DataFrame:
    """Documents as policy records: class, status, jurisdiction, domains and flags follow the id."""
    i = F.col("doc_id")
    first, second = pick(DOMAINS, i), pick(DOMAINS, i + 3)
    return docs.select(
        i.alias("id"),
        F.floor(i / 5).cast("long").alias("document_id"),
        "text",
        pick(CLASSES, i).alias("source_class"),
        pick(STATUSES, i).alias("document_status"),
        pick(JURISDICTIONS, i).alias("jurisdiction"),
        F.when((i % 10) == 5, "Wicklow").otherwise(pick(DETAILS, i)).alias("jurisdiction_detail"),
        F.when(i % 3 == 0, F.array(first, second)).when(i % 19 == 1, F.array().cast("array<string>")).otherwise(F.array(first)).alias("domains"),
        (i % 13 != 0).alias("eligible"),
        (i % 17 == 0).alias("review"),
        F.lit(None).cast("string").alias("legal_status"),
    )


RECORDS_SQL = (
    "select doc_id as id, doc_id // 5 as document_id, text, "
    f"{sql_pick(CLASSES, 'doc_id')} as source_class, {sql_pick(STATUSES, 'doc_id')} as document_status, {sql_pick(JURISDICTIONS, 'doc_id')} as jurisdiction, "
    f"case when doc_id % 10 = 5 then 'Wicklow' else {sql_pick(DETAILS, 'doc_id')} end as jurisdiction_detail, "
    f"case when doc_id % 3 = 0 then [{sql_pick(DOMAINS, 'doc_id')}, {sql_pick(DOMAINS, 'doc_id + 3')}] when doc_id % 19 = 1 then []::varchar[] else [{sql_pick(DOMAINS, 'doc_id')}] end as domains, "
    "doc_id % 13 <> 0 as eligible, doc_id % 17 = 0 as review from documents"
)

SITE_SPAN = 20000


def sites(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(k.alias("site_id"), (600000 + (k * 15013) % SITE_SPAN).cast("double").alias("x"), (750000 + (k * 27017) % SITE_SPAN).cast("double").alias("y"))


SITES_SQL = "select s_suppkey as site_id, (600000 + (s_suppkey * 15013) % 20000)::double as x, (750000 + (s_suppkey * 27017) % 20000)::double as y from supplier"


def zone_centres(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("feature_id"),
        (600000 + (k * 7919) % SITE_SPAN).cast("double").alias("zx"),
        (750000 + (k * 104729) % SITE_SPAN).cast("double").alias("zy"),
        (F.col("p_size") * 20).cast("double").alias("half"),
        F.col("p_type").alias("zone_type"),
    )


ZONES_SQL = (
    "select p_partkey as feature_id, (600000 + (p_partkey * 7919) % 20000)::double as zx, (750000 + (p_partkey * 104729) % 20000)::double as zy, "
    "(p_size * 20)::double as half, p_type as zone_type from part"
)


def zones(part: DataFrame) -> DataFrame:
    from sitelens.functions import geo

    return zone_centres(part).withColumn("rings", geo.square(F.col("zx"), F.col("zy"), F.col("half"))).drop("zx", "zy", "half")


def _spot(key: str, a: int, b: int) -> tuple[Column, Column]:
    k = F.col(key)
    return (600000 + (k * a) % SITE_SPAN).cast("double").alias("x"), (750000 + (k * b) % SITE_SPAN).cast("double").alias("y")


def applications(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("feature_id"), *_spot("o_orderkey", 7919, 104729), F.col("o_orderstatus").alias("status"))


APPLICATIONS_SQL = (
    "select o_orderkey as feature_id, (600000 + (o_orderkey * 7919) % 20000)::double as fx, (750000 + (o_orderkey * 104729) % 20000)::double as fy, o_orderstatus as status from orders"
)


def assets(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    kv = F.when(k % 7 == 0, "unknown").otherwise(F.concat((k % 12 * 10).cast("string"), F.lit(" kV")))
    return customer.select(k.alias("feature_id"), *_spot("c_custkey", 15731, 48611), F.col("c_mktsegment").alias("asset_class"), kv.alias("kv"))


ASSETS_SQL = (
    "select c_custkey as feature_id, (600000 + (c_custkey * 15731) % 20000)::double as fx, (750000 + (c_custkey * 48611) % 20000)::double as fy, c_mktsegment as asset_class, "
    "case when c_custkey % 7 = 0 then 'unknown' else (c_custkey % 12 * 10)::varchar || ' kV' end as kv from customer"
)


def faulty_zones(part: DataFrame) -> DataFrame:
    """Zones of which five in six are faulty by their id: a bow-tie, overlapping parts, a part outside, a spike, a line; some are empty."""
    from sitelens.functions import geo

    at = lambda a, b: geo.point(F.col("zx") + F.col("half") * a, F.col("zy") + F.col("half") * b)
    ring = lambda *spots: F.array(*[at(a, b) for a, b in [*spots, spots[0]]])
    square = ring((-1, -1), (1, -1), (1, 1), (-1, 1))
    shapes = [
        F.array(square),
        F.array(ring((-1, -1), (1, 1), (1, -1), (-1, 1))),
        F.array(square, ring((0, 0), (2, 0), (2, 2), (0, 2))),
        F.array(square, ring((2.5, -0.5), (3.5, -0.5), (3.5, 0.5), (2.5, 0.5))),
        F.array(ring((-1, -1), (1, -1), (1, 0), (3, 0), (1, 0), (1, 1), (-1, 1))),
        F.array(ring((-1, -1), (1, 1), (0, 0))),
    ]
    k = F.col("feature_id")
    rings = F.when(k % 35 == 34, F.array().cast("array<array<struct<x:double,y:double>>>"))
    for i, shape in enumerate(shapes):
        rings = rings.when(k % 6 == i, shape)
    return zone_centres(part).withColumn("rings", rings).select("feature_id", "zone_type", "rings")


#: Squares of half side h cover 4 h h; the shapes' areas follow from theirs.
FAULTY_SQL = (
    f"select feature_id, zone_type, half, case when feature_id % 35 = 34 then 'EMPTY' else ['VALID', 'REPAIRED', 'REPAIRED', 'VALID', 'REPAIRED', 'UNUSABLE'][feature_id % 6 + 1] end as geometry_state, "
    f"[4, 2, 6, 5, 4, null][feature_id % 6 + 1] * half * half as area, [1, 2, 2, 2, 1, null][feature_id % 6 + 1] as parts from ({ZONES_SQL})"
)
