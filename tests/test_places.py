"""Spatial joins over many rows of few places: compared once, listed out whole, nothing broadcast by the size of its files."""

from __future__ import annotations

import math
from contextlib import contextmanager
from threading import Timer

import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import evaluators, layers, site_evidence, spatial


@contextmanager
def within(spark, seconds):
    """Stops the jobs of a query that compares all rows with all rows."""
    timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def sites_at(spark, n, places=1):
    return spark.range(n).selectExpr("id as site_id", f"cast(1000 + id % {places} * 10 as double) as x", "cast(2000 + id % 1 as double) as y")


def points_at(spark, n):
    return spark.range(n).selectExpr("id as feature_id", "cast(1300 + id % 1 as double) as x", "cast(2400 + id % 1 as double) as y", "concat('p', id % 3) as status")


def squares_at(spark, n, half=400):
    return spark.range(n).select(F.col("id").alias("feature_id"), geo.square(1000 + F.col("id") % 1, 2000 + F.col("id") % 1, F.lit(float(half))).alias("rings"))


def test_copies_are_compared_once(spark):
    sites, points, squares = sites_at(spark, 60_000), points_at(spark, 1_000_000), squares_at(spark, 100_000)
    with within(spark, 90):
        counts = spatial.radius_counts(sites, points, (1000, 3000))
        assert counts.agg(F.count("*"), F.min("n_1_km"), F.max("n_3_km")).first() == (60_000, 1_000_000, 1_000_000)
        near = spatial.k_within(sites, points, 1000.0, 3)
        assert near.count() == 180_000 and {(r.rank, r.feature_id, r.distance) for r in near.select("rank", "feature_id", "distance").distinct().collect()} == {(1, 0, 500.0), (2, 1, 500.0), (3, 2, 500.0)}
        nearest = spatial.nearest_polygon(sites, squares.where("feature_id >= 7"))
        assert nearest.count() == 60_000 and nearest.select("feature_id", "distance").distinct().collect() == [(7, 0.0)]
        covered = site_evidence.covering(sites, squares, "flood")
        assert covered.agg(F.count("*"), F.min("value"), F.max("value")).first() == (60_000, 100_000, 100_000)


def test_lists_of_any_length_are_whole(spark):
    n = 2 * spatial.LISTED + 3
    sites, points, squares = sites_at(spark, n), points_at(spark, n), squares_at(spark, n)
    pairs = spatial.within_radius(sites, points, 500.0)
    assert pairs.columns == ["feature_id", "fx", "fy", "status", "site_id", "x", "y", "distance"]
    assert pairs.select("site_id", "feature_id").distinct().count() == pairs.count() == n * n and spatial.within_radius(sites, points, 499.9).isEmpty()
    hits = spatial.intersecting(sites, squares)
    assert hits.columns == ["site_id", "x", "y", "feature_id", "rings"] and hits.select("site_id", "feature_id").distinct().count() == hits.count() == n * n
    one = layers.overlaps(sites, squares).where("site_id = 5").first()
    assert (one.n, one.multiple, one.feature_ids) == (n, True, ",".join(map(str, range(n))))


def test_cells_listed_are_not_broadcast(spark):
    sites, points, squares = sites_at(spark, 500, 50), points_at(spark, 500), squares_at(spark, 500, 600)
    lines = squares.select("feature_id", F.transform("rings", lambda r: F.slice(r, 1, 2)).alias("rings"))
    kinds = squares.withColumn("kind", F.lit("SAC"))
    for out in (spatial.nearest_polygon(sites, squares), spatial.radius_counts(sites, points, (1000,)), spatial.k_within(sites, points, 1000.0, 2), spatial.intersecting(sites, squares), spatial.within_radius(sites, points, 1000.0)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert evaluators.biodiversity(sites, kinds, ("SAC",)).where("intersects and nearest_feature_id = 0").count() == 500
    got = evaluators.ground(sites, squares, points.select("feature_id", "x", "y"), lines, (1000,))
    assert got.where("groundwater = 500 and multiple and n_1_km = 500 and karst_id = 0 and connection_id = 0").count() == 500


def test_pairs_of_a_full_cell_are_dealt_to_tasks(spark):
    """All pairs of a cell were formed by one task, and a few tasks were joined into one by their bytes."""
    n = 8 * spatial.BLOCK
    sites = spark.range(30).selectExpr("id as site_id", "cast(1000 + id as double) as x", "2000d as y")
    points = spark.range(n).selectExpr("id as feature_id", "cast(1100 + id % 100 as double) as x", "cast(2000 + id as double) as y")
    pairs = spatial.within_radius(sites, points, 10000.0)
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 30 * n and max(r["count"] for r in tasks) <= 30 * n / 2
    assert pairs.select("site_id", "feature_id").distinct().count() == 30 * n


def test_pairs_keep_all_columns(spark):
    """One column and several, columns of one name on both sides, ids that are null."""
    sites = spark.createDataFrame([("s", 0.0, 1, 0.0), (None, 0.0, 2, 0.0)], "site_id string, x double, status int, y double")
    points = spark.createDataFrame([(3.0, 7, 4.0), (3.0, None, 4.0), (300.0, 8, 4.0)], "x double, feature_id long, y double")
    out = spatial.within_radius(sites, points, 5.0)
    assert out.columns == ["fx", "feature_id", "fy", "site_id", "x", "status", "y", "distance"]
    assert {tuple(r) for r in out.collect()} == {(3.0, f, 4.0, s, 0.0, n, 0.0, 5.0) for f in (7, None) for s, n in (("s", 1), (None, 2))}
    named = points.withColumn("status", F.lit("p"))
    both = spatial.within_radius(sites, named, 5.0)
    assert both.columns == ["fx", "feature_id", "fy", "status", "site_id", "x", "status", "y", "distance"] and both.count() == 4


@pytest.mark.parametrize("digits", [0, 3, 6])
def test_lengths_are_rounded_as_round_does(spark, digits):
    step = 10.0**-digits
    values = [v for n in (0, 1, 2, 999, 1234567, 9999999) for m in (0.0, 0.25, 0.49999, 0.5, 0.500001, 0.75) for v in ((n + m) * step, math.nextafter((n + m) * step, math.inf), math.nextafter((n + m) * step, -1.0))]
    rows = spark.createDataFrame([(v,) for v in [*values, None, math.inf, math.nan, 1e300, 0.0005, 1.0005, 8.0005, 2.6855]], "v double")
    other = rows.union(spark.range(20_000).select(F.rand(5) * 20000)).where(~(geo.rounded(F.col("v"), digits).eqNullSafe(F.round("v", digits))))
    assert other.isEmpty()


def test_places_nowhere_stay(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 5.0), (3, 9e5, 9e5)], "site_id long, x double, y double")
    points, squares = points_at(spark, 2), squares_at(spark, 2)
    assert sorted(map(tuple, spatial.radius_counts(sites, points, (3000,)).collect())) == [(1, 2), (2, 0), (3, 0)]
    assert sorted(map(tuple, layers.overlaps(sites, squares).collect())) == [(1, 0, False, ""), (2, 0, False, ""), (3, 0, False, "")]
    assert sorted(r.value for r in site_evidence.nearby(sites, points, "planning", 3000.0).collect()) == [0, 0, 2]


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 0), (2, 1, 0, 3, 2), (0, 2, 1, 3, 0), (0, 1, 2, 0, 0), (0, 1, 1, 3, 0)])
def test_only_rectangles_are_boxes(spark, order):
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    row = spark.createDataFrame([([[corners[i] for i in order]],)], "rings array<array<struct<x double, y double>>>")
    box = spatial.boxed(row).select(geo.is_box(F.col("rings"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("b")).first().b
    assert box == (order in [(0, 1, 2, 3, 0), (2, 1, 0, 3, 2)])
    for x, y in ((0.2, 0.5), (1.0, 0.9), (1.0, 1.0), (3.0, 0.5)):
        want = row.select(geo.covers(F.col("rings"), F.lit(x), F.lit(y)).alias("c")).first().c
        site = spark.createDataFrame([(1, x, y)], "site_id long, x double, y double")
        assert (spatial.intersecting(site, row.withColumn("feature_id", F.lit(1))).count() == 1) == want
