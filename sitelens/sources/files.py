"""File sources: inventory, JSON Lines, CSV and GeoJSON, each read by Spark's own readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import stable_dataset_id
from sitelens.sources import geojson


def inventory(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """One row per file under ``root``: path, size, time, digest, domain (first path part) and stable id.

    Contents are hashed where they are read; placeholders (``.gitkeep``) are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    out = files.where(~F.endswith("path", F.lit(".gitkeep")))
    if extensions:
        out = out.where(F.lower(F.substring_index("path", ".", -1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    domain = F.split_part(relative, F.lit("/"), F.lit(1))
    return out.select(
        relative.alias("path"), domain.alias("domain"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"), stable_dataset_id(relative, domain).alias("dataset_id")
    ).orderBy("path")


def first_pattern(path: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Source of the first glob pattern that matches (in the order given), else null."""
    out = None
    for glob, source in patterns:
        expr = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in glob)
        hit = F.rlike(path, F.lit(f"^{expr}$"))
        out = F.when(hit, source) if out is None else out.when(hit, source)
    return out if out is not None else F.lit(None).cast("string")


class MalformedRows(ValueError):
    """A line that is not a JSON object, with the first such text."""


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON Lines by an explicit schema; blank lines are skipped. With ``strict`` any malformed line raises."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if strict:
        bad = spark.read.text(path).where(F.trim("value") != "").where(~F.rlike(F.trim("value"), F.lit(r"^\{.*\}$")) | F.from_json("value", "map<string,string>").isNull()).head(1)
        if bad:
            raise MalformedRows(f"not a JSON object: {bad[0].value[:80]}")
    return rows.drop("_corrupt")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header row; all text unless a schema is given, so no pass is spent on inference."""
    reader = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a collection: the listed properties, geometry type and ``rings`` (parts for lines, one vertex list for points).

    A large file is read by as many tasks as it has byte ranges.
    """
    shape = f"type string, properties struct<{_struct(properties)}>, geometry struct<{_struct('type string, coordinates string')}>"
    features = geojson.read_objects(spark, path).select(F.from_json("text", shape).alias("f")).where("f.type = 'Feature'")
    features = features.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("_c"))
    return features.withColumn("rings", _rings(F.col("geometry_type"), F.col("_c"))).drop("_c")


def _struct(fields: str) -> str:
    return ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in fields.split(", "))


def _rings(kind: Column, raw: Column) -> Column:
    pair = lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))
    line = lambda r: F.transform(r, pair)
    point = F.array(F.array(pair(F.from_json(raw, "array<double>"))))
    flat = F.array(line(F.from_json(raw, "array<array<double>>")))
    nested = F.transform(F.from_json(raw, "array<array<array<double>>>"), line)
    multi = F.transform(F.flatten(F.from_json(raw, "array<array<array<array<double>>>>")), line)
    return F.when(kind == "Point", point).when(kind.isin("LineString", "MultiPoint"), flat).when(kind.isin("Polygon", "MultiLineString"), nested).when(kind == "MultiPolygon", multi)


def geojson_is_collection(spark: SparkSession, path: str) -> DataFrame:
    """Whether the first two mebibytes of each file name a feature collection."""
    files = spark.read.format("binaryFile").load(path)
    head = F.decode(F.substring("content", 1, 2 << 20), "UTF-8")
    return files.select("path", F.rlike(head, F.lit(r'"type"\s*:\s*"FeatureCollection"')).alias("is_collection"))


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, position, href, title`` of the anchors of each page, in order."""
    pattern = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    href, body = F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2))
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(href.alias("href"), body.alias("body"))).alias("position", "a"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.body"), "<[^>]*>", ""), r"\s+", " "))
    return rows.select("id", "position", F.col("a.href").alias("href"), title.alias("title"))


def pick_link(links: DataFrame, title: str) -> DataFrame:
    """Per page the link whose title equals, else contains, the wanted one (caseless), first in order."""
    low, want = F.lower("title"), title.lower()
    fit = F.when(low == want, 0).when(F.contains(low, F.lit(want)), 1)
    return links.withColumn("_fit", fit).where("_fit is not null").groupBy("id").agg(F.min_by("href", F.struct("_fit", "position")).alias("href"))


def joined_url(base: Column, href: Column) -> Column:
    """Absolute form of a link: full links stay, rooted ones take the host, others the folder."""
    host = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "/")
    return F.when(F.rlike(href, F.lit(r"^[a-z][a-z0-9+.-]*:")), href).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(folder, href))
