"""Python data sources for formats Spark has no reader for: shapefile zips and spreadsheets.

Each layer of a zip, or each workbook, is one input partition of the data sources, which read through the executors' file system view; name
files by a mounted or local path there. ``read_workbooks`` and ``read_shapefile_zips`` take many files from any store that Spark can open, all
sheets and layers, and give damaged files as rows with their error.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COMPANIONS = (".dbf", ".shx", ".prj")


def safe_members(archive: zipfile.ZipFile) -> list[str]:
    """Member names in order; absolute names and parent steps raise."""
    names = sorted(archive.namelist())
    for n in names:
        if n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) or re.match(r"^[A-Za-z]:", n):
            raise ValueError(f"unsafe member name {n!r}")
    return names


def layer_names(names: list[str]) -> list[str]:
    return [n[:-4] for n in names if n.lower().endswith(".shp")]


def missing_companions(names: list[str]) -> dict[str, list[str]]:
    """Per layer the companion files that are absent (caseless)."""
    low = {n.lower() for n in names}
    gaps = {layer: [c for c in COMPANIONS if layer.lower() + c not in low] for layer in layer_names(names)}
    return {k: v for k, v in gaps.items() if v}


def read_dbf(raw: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Field names and records of a dBASE table, values as trimmed text, deleted records left out."""
    count, header, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        start = header + i * size
        if raw[start : start + 1] == b"*":
            continue
        spot, row = start + 1, []
        for _, width in fields:
            text = raw[spot : spot + width].decode("utf-8", "replace").strip()
            row.append(text or None)
            spot += width
        rows.append(row)
    return [f for f, _ in fields], rows


def read_shp(raw: bytes) -> list[list[list[tuple[float, float]]]]:
    """Parts of each shape: rings of polygons, lines, or one vertex for points; null shapes are empty."""
    at, out = 100, []
    while at + 12 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        body, (kind,) = at + 8, struct.unpack_from("<i", raw, at + 8)
        parts: list[list[tuple[float, float]]] = []
        if kind in (1, 11, 21):
            parts = [[struct.unpack_from("<2d", raw, body + 4)]]
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack_from("<2i", raw, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", raw, body + 44), n_points]
            base = body + 44 + 4 * n_parts
            flat = struct.unpack_from(f"<{2 * n_points}d", raw, base)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            parts = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind in (8, 18, 28):
            (n_points,) = struct.unpack_from("<i", raw, body + 36)
            flat = struct.unpack_from(f"<{2 * n_points}d", raw, body + 40)
            parts = [list(zip(flat[::2], flat[1::2], strict=True))]
        elif kind != 0:
            raise ValueError(f"shape type {kind} is not supported")
        out.append(parts)
        at = body + 2 * words
    return out


class _Layer(InputPartition):
    def __init__(self, path: str, layer: str) -> None:
        self.path, self.layer = path, layer


class ShapefileZip(DataSource):
    """``spark.read.format("shapefile_zip").load(path)``: a row per feature with its attributes and rings."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_zip"

    def schema(self) -> str:
        return "source_layer string, feature_no int, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>, crs_wkt string"

    def reader(self, schema) -> DataSourceReader:
        return _ShapefileReader(self.options["path"])


class _ShapefileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            names = safe_members(z)
            gaps = missing_companions(names)
            if gaps:
                raise ValueError(f"companion files are missing: {gaps}")
            return [_Layer(self.path, x) for x in layer_names(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            real = {n.lower(): n for n in safe_members(z)}
            part = lambda ext: z.read(real[partition.layer.lower() + ext])
            fields, rows = read_dbf(part(".dbf"))
            wkt = part(".prj").decode("utf-8", "replace").strip()
            for i, (row, parts) in enumerate(zip(rows, read_shp(part(".shp")), strict=True)):
                yield partition.layer.rsplit("/", 1)[-1], i, dict(zip(fields, row, strict=True)), [[{"x": x, "y": y} for x, y in p] for p in parts], wkt


class Workbook(DataSource):
    """``spark.read.format("workbook").option("header_row", n).load(path)``: first sheet as name-value maps."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row_no int, cells map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader(self.options["path"], int(self.options.get("header_row", "0")))


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, header_row: int) -> None:
        self.path, self.header_row = path.removeprefix("file://"), header_row

    def partitions(self) -> list[InputPartition]:
        return [_Layer(self.path, "sheet1")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = list(sheet_rows(open(self.path, "rb").read()))
        if len(rows) <= self.header_row:
            return
        names = rows[self.header_row]
        for i, row in enumerate(rows[self.header_row + 1 :]):
            yield i, {names[c] or f"column_{c}": v for c, v in row.items() if c in names}


def sheet_names(raw: bytes) -> dict[str, str]:
    """The sheets of a workbook in its order, by name, and the parts of the file that hold them."""
    space, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        held = z.namelist()
        if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(held):
            return {n.rsplit("/", 1)[1].removesuffix(".xml"): n for n in sorted(held, key=lambda n: (len(n), n)) if n.startswith("xl/worksheets/sheet")}
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")
        parts = {s.get("name"): targets.get(s.get(rel), "") for s in sheets}
        return {k: v.removeprefix("/") if v.startswith("/") else f"xl/{v}" for k, v in parts.items()}


def sheet_rows(raw: bytes, part: str | None = None) -> Iterator[dict[int, str | None]]:
    """Rows of a sheet of an Office Open XML workbook, the first where none is named, as column number to text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        sheet = part or next(iter(sheet_names(raw).values()))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{space}row"):
            out: dict[int, str | None] = {}
            for cell in row.iter(f"{space}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "A")).group()
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                value, text = cell.find(f"{space}v"), cell.find(f"{space}is")
                if cell.get("t") == "s" and value is not None:
                    out[column - 1] = shared[int(value.text)]
                elif text is not None:
                    out[column - 1] = "".join(t.text or "" for t in text.iter(f"{space}t"))
                else:
                    out[column - 1] = value.text if value is not None else None
            yield out


SHEETS = "path string, sheet string, row_no int, cells map<string,string>, error string"
FEATURES = "path string, source_layer string, feature_no int, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>, crs_wkt string, error string"


def _each_file(spark: SparkSession, path: str, pattern: str, schema: str, rows: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """``rows`` of each file that Spark's binary reader finds, one task a file; a file that cannot be read adds a row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held: list[dict] = []
                try:
                    for row in rows(raw):
                        held.append({"path": at, "error": None, **row})
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, shape)
                            held = []
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError, StopIteration) as e:
                    held.append({"path": at, "error": f"{type(e).__name__}: {e}"})
                if held:
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in shape} for r in held], shape)

    return files.mapInArrow(run, schema)


def read_workbooks(spark: SparkSession, path: str, header_row: int = 0, sheet: str | None = None) -> DataFrame:
    """``SHEETS``: the rows below the header row of every sheet, or of the one named, of each workbook under ``path``."""

    def rows(raw: bytes) -> Iterator[dict]:
        for name, part in sheet_names(raw).items():
            if sheet is not None and name != sheet:
                continue
            lines = sheet_rows(raw, part)
            names: dict[int, str | None] = {}
            for i, line in enumerate(lines):
                if i == header_row:
                    names = line
                elif i > header_row:
                    cells = {names[c] or f"column_{c}": v for c, v in line.items() if c in names}
                    yield {"sheet": name, "row_no": i - header_row - 1, "cells": list(cells.items())}

    return _each_file(spark, path, "*.xlsx", SHEETS, rows)


def read_shapefile_zips(spark: SparkSession, path: str) -> DataFrame:
    """``FEATURES`` of every layer of each shapefile archive under ``path``, from any store Spark can open."""

    def rows(raw: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = safe_members(z)
            gaps = missing_companions(names)
            if gaps:
                raise ValueError(f"companion files are missing: {gaps}")
            real = {n.lower(): n for n in names}
            for layer in layer_names(names):
                part = lambda ext, layer=layer: z.read(real[layer.lower() + ext])
                fields, records = read_dbf(part(".dbf"))
                wkt = part(".prj").decode("utf-8", "replace").strip()
                for i, (record, parts) in enumerate(zip(records, read_shp(part(".shp")), strict=True)):
                    rings = [[{"x": x, "y": y} for x, y in p] for p in parts]
                    yield {"source_layer": layer.rsplit("/", 1)[-1], "feature_no": i, "attributes": list(zip(fields, record, strict=True)), "rings": rings, "crs_wkt": wkt}

    return _each_file(spark, path, "*.zip", FEATURES, rows)


def register(spark) -> None:
    spark.dataSource.register(ShapefileZip)
    spark.dataSource.register(Workbook)
