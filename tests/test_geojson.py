"""GeoJSON read by byte ranges: the same features whatever the ranges, braces and quotes in strings included."""

from __future__ import annotations

import json
import random

import pytest

from sitelens.sources import files, geojson


def collection(n, seed=1, indent=None, late_type=False):
    rng = random.Random(seed)
    odd = ['plain', 'a } b', '{"x": [1]}', 'quote " here', "back\\slash \\", "é } ü", "", "]}[{", '\\"}']
    features = []
    for i in range(n):
        ring = [[rng.random(), rng.random()] for _ in range(rng.randint(3, 40))]
        props = {"id": i, "name": rng.choice(odd) * rng.randint(0, 3), "deep": {"a": [{"b": "}"}]}}
        parts = [("type", "Feature"), ("properties", props), ("geometry", {"type": "Polygon", "coordinates": [[*ring, ring[0]]]})]
        features.append(dict(reversed(parts) if late_type else parts))
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG } 4326"}}, "bbox": [0, 0, 1, 1], "other": [{"type": "note"}]}
    return json.dumps(head | {"features": features, "after": {"x": 1}}, indent=indent, ensure_ascii=False), features


@pytest.mark.parametrize(("indent", "late", "size"), [(None, False, 6000), (2, True, 2500)])
def test_features_do_not_depend_on_ranges(spark, tmp_path, indent, late, size):
    for k, n in enumerate((60, 1, 0)):
        text, features = collection(n, k, indent, late)
        (tmp_path / f"{k}.geojson").write_text(text + "\n" * k, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = str(tmp_path / "0.geojson")
        got = files.read_geojson(spark, path, "id long, name string")
        rows = sorted(got.collect(), key=lambda r: r.id)
        ranges = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        every = geojson.read_objects(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    _, features = collection(60, 0, indent, late)
    assert ranges > 3
    assert [(r.id, r.name) for r in rows] == [(f["properties"]["id"], f["properties"]["name"]) for f in features]
    assert [[[tuple(p) for p in ring] for ring in r.rings] for r in rows] == [[[tuple(p) for p in ring] for ring in f["geometry"]["coordinates"]] for f in features]
    # Beside the features each file holds one other object in a list and one in an object.
    assert every == 61 + 3 + 3
