"""Sources and sinks on small files; streaming appends; properties of operators."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import corpus, diff, layers, lexical, portfolio, spatial
from sitelens.sources import archives, files, sinks, validation
from sitelens.streaming import runs as streaming


def test_inventory(spark, tmp_path):
    for name, body in (("grid/a.csv", b"x"), ("grid/.gitkeep", b""), ("flood/Ä b.zip", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = files.inventory(spark, str(tmp_path)).collect()
    assert [(r.path, r.domain) for r in got][1] == ("grid/a.csv", "grid") and len(got) == 2
    assert got[1].dataset_id.startswith("grid-a-") and len(got[1].sha256) == 64


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n[1, 2]\n')
    assert files.read_jsonl(spark, str(good), "a int, b string").where("a is not null").count() == 2
    with pytest.raises(files.MalformedRows):
        files.read_jsonl(spark, str(bad), "a int")


def test_geojson(spark, tmp_path):
    feature = lambda kind, c, n: {"type": "Feature", "properties": {"NAME": n, "SECRET": "s"}, "geometry": {"type": kind, "coordinates": c}}
    box = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [box], "p"), feature("MultiPolygon", [[box], [box]], "m"), feature("Point", [1, 2], "d"), feature("LineString", box[:2], "l")]}))
    got = {r.NAME: r for r in files.read_geojson(spark, str(path), "NAME string").collect()}
    assert [len(got[k].rings) for k in "pmdl"] == [1, 2, 1, 1]
    assert (got["d"].rings[0][0].x, got["d"].rings[0][0].y) == (1.0, 2.0)
    assert files.geojson_is_collection(spark, str(path)).first().is_collection


def shapefile_zip(path, extra=()):
    dbf = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 65, 11) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes((10, 0)) + bytes(14) + b"\r" + b" " + b"first".ljust(10) + b" " + b"second".ljust(10)
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    shp = bytes(100) + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((body, point)))
    with zipfile.ZipFile(path, "w") as z:
        for name, data in (("a/L1.shp", shp), ("a/l1.DBF", dbf), ("a/L1.shx", b""), ("a/L1.prj", b"WKT"), *extra):
            z.writestr(name, data)


def test_shapefile_zip(spark, tmp_path):
    archives.register(spark)
    path = tmp_path / "layers.zip"
    shapefile_zip(path)
    got = spark.read.format("shapefile_zip").load(str(path)).orderBy("feature_no").collect()
    assert [r.attributes["NAME"] for r in got] == ["first", "second"]
    assert (len(got[0].rings[0]), got[1].rings[0][0].x, got[0].crs_wkt, got[0].source_layer) == (4, 3.0, "WKT", "L1")


def test_zip_checks(tmp_path):
    path = tmp_path / "x.zip"
    shapefile_zip(path, [("b/L2.shp", b"")])
    with zipfile.ZipFile(path) as z:
        assert archives.missing_companions(archives.safe_members(z)) == {"b/L2": [".dbf", ".shx", ".prj"]}
    shapefile_zip(path, [("../evil", b"")])
    with zipfile.ZipFile(path) as z, pytest.raises(ValueError):
        archives.safe_members(z)


def test_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v, t="": f'<c r="{r}"{t}><v>{v}</v></c>'
    rows = [cell("A1", 0, ' t="s"'), cell("A2", 1, ' t="s"') + cell("B2", 2, ' t="s"'), cell("A3", 5) + cell("B3", 7.5)]
    sheet = f"<worksheet {space}><sheetData>" + "".join(f'<row r="{i + 1}">{r}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Title</t></si><si><t>X</t></si><si><t>Y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    path = tmp_path / "b.xlsx"
    path.write_bytes(buffer.getvalue())
    archives.register(spark)
    got = spark.read.format("workbook").option("header_row", "1").load(str(path)).collect()
    assert [r.cells for r in got] == [{"X": "5", "Y": "7.5"}]
    names = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "two.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} {names}><sheets><sheet name="Points" r:id="r2"/><sheet name="Notes" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Title</t></si><si><t>X</t></si><si><t>Y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet9.xml", sheet.replace("7.5", "9"))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    every = {(r.path.rsplit("/", 1)[1], r.sheet, str(r.cells), bool(r.error)) for r in archives.read_workbooks(spark, str(tmp_path), 1).collect()}
    assert every == {
        ("b.xlsx", "sheet1", str({"X": "5", "Y": "7.5"}), False), ("two.xlsx", "Points", str({"X": "5", "Y": "9"}), False), ("two.xlsx", "Notes", str({"X": "5", "Y": "7.5"}), False), ("bad.xlsx", None, "None", True),
    }
    assert [r.sheet for r in archives.read_workbooks(spark, str(tmp_path / "two.xlsx"), 1, "Notes").collect()] == ["Notes"]


def test_many_shapefile_zips(spark, tmp_path):
    shapefile_zip(tmp_path / "one.zip")
    shapefile_zip(tmp_path / "gap.zip", [("b/L2.shp", b"")])
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = {}
    for r in archives.read_shapefile_zips(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    rows = sorted(got["one.zip"], key=lambda r: r.feature_no)
    assert [(r.source_layer, r.attributes["NAME"], len(r.rings[0]), r.crs_wkt, r.error) for r in rows] == [("L1", "first", 4, "WKT", None), ("L1", "second", 1, "WKT", None)]
    assert "companion" in got["gap.zip"][0].error and "BadZipFile" in got["bad.zip"][0].error


def test_csv_header_and_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿OBJECTID,Plan Name\n1,x\n", encoding="utf-8")
    assert validation.csv_header(spark, str(path)) == ["OBJECTID", "Plan Name"]
    assert layers.resolve_columns(["ObjectId", "Name"], ["OBJECTID", "name", "zzz", "NAME"]) == (["ObjectId", "Name"], ["zzz"])
    with pytest.raises(ValueError):
        layers.project(spark.range(1), ["id"], ["missing"])


def test_publish_keeps_the_old_set_on_failure(spark, tmp_path):
    target = f"file://{tmp_path}/set"
    manifest = lambda d: spark.createDataFrame([(d,)], "digest string")
    sinks.publish({"t": spark.range(3)}, target, manifest("one"))
    assert sinks.is_published(spark, target) and not sinks.is_stale(spark, target, "one") and sinks.is_stale(spark, target, "two")
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        sinks.publish({"t": broken}, target, manifest("two"))
    assert spark.read.parquet(f"{target}/t").count() == 3 and not sinks.is_stale(spark, target, "one")
    assert [p.name for p in tmp_path.iterdir()] == ["set"]


def test_streaming_append(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id long, project_id long, created_at timestamp, workflow_status string"
    rows = [(1, 1, "COMPLETE"), (2, 1, "FAILED"), (3, 2, "REQUIRES_HUMAN_REVIEW"), (1, 1, "COMPLETE")]
    df = spark.createDataFrame([(r, p, s) for r, p, s in rows], "run_id long, project_id long, workflow_status string")
    df = df.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("run_id"))).select("run_id", "project_id", "created_at", "workflow_status")
    df.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    streaming.append_stream(stream(), target, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.run_id for r in spark.read.parquet(target).collect()) == [1, 3]
    streaming.latest_stream(stream(), str(tmp_path / "latest"), str(tmp_path / "cp2")).awaitTermination(60)
    got = {r.project_id: r.latest_run_id for r in spark.read.parquet(str(tmp_path / "latest")).collect()}
    assert got == {1: 1, 2: 3}


def test_spatial_fixture(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "site_id int, x double, y double")
    points = spark.createDataFrame([(1, 500.0, 0.0), (2, 2000.0, 0.0), (3, 6000.0, 0.0)], "feature_id int, x double, y double")
    assert tuple(spatial.radius_counts(sites, points, (1000, 3000, 5000)).first()) == (1, 1, 2, 2)
    boxes = spark.createDataFrame([(7, 2000.0, 100.0), (8, 90000.0, 100.0)], "feature_id int, x double, h double").select("feature_id", geo.square(F.col("x"), F.lit(0.0), F.col("h")).alias("rings"))
    got = spatial.nearest_polygon(sites, boxes).first()
    assert (got.feature_id, got.distance) == (7, 1900.0)
    far = spatial.nearest_polygon(sites, boxes.where("feature_id = 8")).first()
    assert (far.feature_id, far.distance) == (8, 89900.0)
    with pytest.raises(ValueError):
        spatial.radius_counts(sites, points, (1000, 1500))


def test_bm25_of_one_document(spark):
    docs = spark.createDataFrame([(1, "grid grid policy")], "id int, text string")
    q = spark.createDataFrame([("q", "grid grid")], "qid string, query string")
    got = lexical.bm25(lexical.build_index(docs, "id", "text"), q).first()
    import math

    assert got.score == round(math.log(1 + 0.5 / 1.5) * (2 * 2.2 / (2 + 1.2)), 6)
    empty = lexical.bm25(lexical.build_index(docs.limit(0), "id", "text"), q)
    assert empty.count() == 0


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"grid w{i} policy") for i in range(20)], "id int, text string")
    q = spark.createDataFrame([("q", "w3 grid")], "qid string, query string")
    index = lexical.build_index(docs.repartition(5), "id", "text")
    lexical.write_index(index, str(tmp_path), 3)
    again = lexical.bm25(lexical.read_index(spark, str(tmp_path)), q)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lexical.bm25(index, q).collect()))


def test_diff_of_equal_snapshots(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0)], "id int, s string, v double")
    assert {r.change_kind for r in diff.section_diff(a, a, "id", ("s", "v")).collect()} == {"unchanged"}
    b = spark.createDataFrame([(2, "z", 1.0), (3, "y", 1.0)], "id int, s string, v double")
    got = {r.id: (r.change_kind, r.changed_fields) for r in diff.section_diff(a, b, "id", ("s", "v")).collect()}
    assert got == {1: ("removed", ""), 2: ("changed", "s"), 3: ("added", "")}


def test_identity(spark):
    row = spark.createDataFrame([("a", "T", 0), ("", " Te ", 1), (None, "", 2)], "i string, t string, p int")
    got = [r.k for r in row.select(diff.identity(F.col("i"), F.col("t"), "row", F.col("p")).alias("k")).collect()]
    assert got[0] == "a" and got[1].startswith("text:") and len(got[1]) == 21 and got[2] == "row-unmatched-2"


def test_flag_match_and_envelopes(spark):
    records = spark.createDataFrame([(1, ["s1"], "claims that x"), (2, ["s2"], "plain")], "record_id int, source_ids array<string>, text string")
    flags = spark.createDataFrame([(10, "s9", "that x"), (11, "s2", None), (12, "s7", "absent")], "flag_id int, source_id string, original_claim string")
    m = corpus.flag_matches(records, flags)
    assert sorted(map(tuple, m.collect())) == [(10, 1), (11, 2)]
    audit = {r.flag_id: r.n_records for r in corpus.flag_audit(flags, m).collect()}
    assert audit == {10: 1, 11: 1, 12: 0}


def test_upsert_latest_wins(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "k int, v string, at int")
    b = spark.createDataFrame([(1, "new", 2)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in portfolio.upsert(a, b, "k", "at").collect()) == [(1, "new"), (2, "keep")]
