"""Registry files, validation by mode, GeoParquet layers and DOCX blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a stored bounding box, as one struct or as columns of their own.
BBOX = ("xmin", "ymin", "xmax", "ymax")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, position int, kind string, text string, heading boolean, error string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``path, entry, error``: the entries of each JSON registry file, a list or one object, as raw JSON text.

    A file that is not such JSON gives one row with the reason and no entry; others are read all the same.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("MALFORMED"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    entries = F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), F.array("v")).otherwise(F.array(F.lit(None).cast("variant")))
    rows = files.withColumn("kind", kind).select("path", "kind", F.explode(entries).alias("e"))
    good = F.startswith(F.schema_of_variant("e"), F.lit("OBJECT"))
    error = F.when(F.col("e").isNull(), F.when(F.col("kind") == "MALFORMED", "not JSON").otherwise("no list or object")).when(~good, "entry is not an object")
    return rows.select("path", F.when(good, F.to_json("e")).alias("entry"), error.alias("error"))


def validated(sources: DataFrame, checks: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``source_id, mode, valid, message`` of ``sources(source_id, mode, ...)``: each row goes to its mode's check.

    A check maps the rows of its mode to ``source_id, valid, message``. Rows of a mode without a check are invalid.
    """
    known = F.coalesce(F.col("mode").isin(*checks), F.lit(False))
    unknown = F.concat(F.lit("unsupported mode: "), F.coalesce("mode", F.lit("none")))
    out = sources.where(~known).select("source_id", "mode", F.lit(False).alias("valid"), unknown.alias("message"))
    for mode, check in checks.items():
        own = check(sources.where(F.col("mode") == mode))
        out = out.unionByName(own.select("source_id", F.lit(mode).alias("mode"), "valid", "message"))
    return out


def _stored_box(layer: DataFrame) -> dict[str, Column] | None:
    """The layer's bounding box columns, if it has any."""
    kinds = dict(layer.dtypes)
    if all(f"{side}:" in kinds.get("bbox", "") for side in BBOX):
        return {side: F.col(f"bbox.{side}") for side in BBOX}
    return {side: F.col(side) for side in BBOX} if all(side in kinds for side in BBOX) else None


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A GeoParquet layer, or those of its features whose stored bounding box touches ``box`` (xmin, ymin, xmax, ymax).

    The comparison reaches the Parquet scan, which skips row groups. A layer without stored boxes is returned whole, as are features
    whose box is null: the exact predicate after this scan decides. Spark's file listing and the executors' page cache
    take the place of a cache of layers in memory.
    """
    layer = spark.read.parquet(path)
    own = _stored_box(layer)
    if box is None or own is None:
        return layer
    x1, y1, x2, y2 = box
    inside = (own["xmax"] >= x1) & (own["xmin"] <= x2) & (own["ymax"] >= y1) & (own["ymin"] <= y2)
    missing = own["xmin"].isNull() | own["ymin"].isNull() | own["xmax"].isNull() | own["ymax"].isNull()
    return layer.where(inside | missing)


def _words(node: ElementTree.Element) -> str:
    parts = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((n.text or "") if n.tag == f"{_W}t" else parts.get(n.tag, "") for n in node.iter())


def docx_blocks(raw: bytes) -> Iterator[tuple[str, str, bool]]:
    """``kind, text, heading`` of the paragraphs and tables of a document's body, in order; blank ones are left out.

    The cells of a table's row are joined by `` | ``, its rows by line ends. Styles are headings by their names or ids.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text, style = _words(node).strip(), node.find(f"{_W}pPr/{_W}pStyle")
            used = style.get(f"{_W}val", "") if style is not None else ""
            if text:
                yield "paragraph", text, names.get(used, used).lower().startswith("heading")
        elif node.tag == f"{_W}tbl":
            rows = (" | ".join(_words(c).strip() for c in r.findall(f"{_W}tc")) for r in node.findall(f"{_W}tr"))
            text = "\n".join(r for r in rows if r.replace("|", "").strip())
            if text:
                yield "table", text, False


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, kind, text, heading, error``: blocks of each DOCX file; one that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def blocks(frames):
        for frame in frames:
            for at, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(at, n, *b, None) for n, b in enumerate(docx_blocks(raw))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(at, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "position", "kind", "text", "heading", "error"], dtype=object)

    return files.mapInPandas(blocks, BLOCKS)
