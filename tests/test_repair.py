"""Polygon repair: shapes with known areas, random self-crossing rings against an even-odd count of points, records and errors."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import repair

RINGS = "array<array<struct<x:double,y:double>>>"


def layer(spark, *shapes):
    return spark.createDataFrame([(i, f"zone {i}", s) for i, s in enumerate(shapes)], f"ZONE_ID long, Name string, rings {RINGS}")


def closed(*spots):
    return [(float(x), float(y)) for x, y in [*spots, spots[0]]]


SQUARE = closed((0, 0), (0, 1), (1, 1), (1, 0))
BOWTIE = closed((0, 0), (1, 1), (0, 1), (1, 0))


def mended(spark, *shapes):
    out = repair.repaired(layer(spark, *shapes), "ZONE_ID").withColumn("area", geo.area(F.col("rings")))
    return {r.ZONE_ID: r for r in out.collect()}


def test_known_shapes(spark):
    got = mended(
        spark,
        [SQUARE],
        [BOWTIE],
        [SQUARE, closed((3, 0), (4, 0), (4, 1), (3, 1))],
        [closed((0, 0), (2, 0), (2, 2), (0, 2)), closed((1, 1), (3, 1), (3, 3), (1, 3))],
        [closed((0, 0), (4, 0), (4, 4), (0, 4)), closed((1, 1), (1, 3), (3, 3), (3, 1))],
        [closed((0, 0), (2, 2), (1, 1))],
        [],
        None,
        [SQUARE[:-1]],
        [closed((0, 0), (4, 0), (4, 4), (2, 4), (1, 2), (3, 2), (2, 4), (0, 4))],
        [SQUARE, SQUARE],
        [[(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]],
    )
    assert [got[i].geometry_state for i in range(12)] == ["VALID", "REPAIRED", "VALID", "REPAIRED", "VALID", "UNUSABLE", "EMPTY", "EMPTY", "REPAIRED", "REPAIRED", "UNUSABLE", "REPAIRED"]
    assert [got[i].area for i in (0, 1, 2, 3, 4, 8, 9, 11)] == pytest.approx([1, 0.5, 2, 6, 12, 1, 14, 0.5])
    assert len(got[1].rings) == 2 and got[0].rings == [[tuple(p) for p in SQUARE]] and got[5].rings is None
    # A ring that touches itself becomes an outer ring and a hole.
    assert sorted(len(r) for r in got[9].rings) == [4, 6]
    assert not got[1].left_over and got[5].left_over


def test_spike_leaves_edges_over(spark):
    got = mended(spark, [closed((0, 0), (1, 0), (1, 0.5), (3, 0.5), (1, 0.5), (1, 1), (0, 1))])
    assert got[0].geometry_state == "REPAIRED" and got[0].left_over and got[0].area == pytest.approx(1)


def test_random_rings_cover_what_the_odd_rule_covers(spark, tmp_path):
    rng = random.Random(5)
    shapes = [[closed(*[(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(4, 14))]) for _ in range(rng.randint(1, 3))] for _ in range(60)]
    before = layer(spark, *shapes)
    repair.repaired(before, "ZONE_ID").where("geometry_state in ('VALID', 'REPAIRED')").write.parquet(f"file://{tmp_path}/after")
    after = spark.read.parquet(f"file://{tmp_path}/after")
    areas = {r.ZONE_ID: r.area for r in after.select("ZONE_ID", geo.area(F.col("rings")).alias("area")).collect()}
    assert len(areas) > 50
    assert repair.wrong_features(after.select("ZONE_ID", "rings"), "ZONE_ID").count() == 0
    spots = np.random.default_rng(2).uniform(-0.5, 12.5, (300, 2))

    def odd(rings, x, y):
        hits = 0
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
                hits += ((ay > y) != (by > y)) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return hits % 2 == 1

    for row in after.collect():
        rings = [[tuple(p) for p in r] for r in row.rings]
        assert [odd(shapes[row.ZONE_ID], x, y) for x, y in spots] == [odd(rings, x, y) for x, y in spots]
        # Outer rings run counter-clockwise, holes clockwise, so signed areas add up.
        if row.geometry_state == "REPAIRED":
            signed = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, r[1:], strict=False)) / 2
            assert signed > 0 and areas[row.ZONE_ID] == pytest.approx(signed)


def test_large_ring(spark):
    """A star of 4,000 edges that crosses itself all round is one feature spread over a grid."""
    n, step = 2001, 1000
    turn = [2 * np.pi * (i * step % n) / n for i in range(n)]
    small = [closed(*[(float(np.cos(a)), float(np.sin(a))) for a in turn[:60]])]
    got = mended(spark, small)
    assert got[0].geometry_state == "REPAIRED" and got[0].area > 0


def test_quality_and_standard_form(spark):
    zones = layer(spark, [SQUARE], [BOWTIE], [closed((0, 0), (2, 2), (1, 1))])
    out, quality = repair.standardised(zones, "ZONE_ID", ["zone_id", "NAME", "owner"], ["ZONE_ID"])
    assert out.columns == ["ZONE_ID", "Name", "rings"] and out.count() == 2
    want = {"feature_count": 3, "invalid_geometry_count_before": 2, "repair_attempted": True, "repaired_geometry_count": 1, "unusable_after_repair_count": 1, "dropped_unusable_feature_count": 1}
    assert want.items() <= quality.items() and quality["missing_optional_columns"] == ["owner"]
    assert quality["invalid_geometry_count_after_repair"] == 0 and quality["output_geometry_type_after_repair"] == "MultiPolygon, Polygon"
    assert all(np.isfinite(quality["valid_spatial_bounds"]))
    with pytest.raises(repair.RepairError) as error:
        repair.standardised(zones, "ZONE_ID", ["Name"], drop_unusable=False)
    assert error.value.quality["unusable_after_repair_count"] == 1
    with pytest.raises(repair.RepairError, match="no usable"):
        repair.standardised(zones.where("ZONE_ID = 2"), "ZONE_ID", ["Name"])
    with pytest.raises(repair.RepairError, match="no usable"):
        repair.standardised(zones.limit(0), "ZONE_ID", ["Name"])
    with pytest.raises(repair.RepairError) as error:
        repair.standardised(zones, "ZONE_ID", ["Name"], ["code"])
    assert error.value.quality == {"missing_required_columns": ["code"]}
