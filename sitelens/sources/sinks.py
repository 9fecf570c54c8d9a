"""Sinks: tables, staged publishing with a commit mark, layer sets."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A small manifest as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_layers(layers: DataFrame, path: str, layer_col: str = "source_layer") -> None:
    """One folder per layer."""
    layers.write.mode("overwrite").partitionBy(layer_col).parquet(path)


def publish(tables: Mapping[str, DataFrame], target: str, manifest: DataFrame) -> None:
    """Writes all tables and the manifest beside ``target``, the manifest last, and swaps the whole set in by two renames.

    The live set is only moved aside, and deleted once the new one is in its place; a failure at any
    step leaves, or puts back, the set as it was.
    """
    spark = manifest.sparkSession
    base, mark = target.rstrip("/"), uuid.uuid4().hex
    stage, aside = f"{base}.staging-{mark}", f"{base}.before-{mark}"
    fs, path = _fs(spark, target)

    def move(a: str, b: str) -> None:
        if not fs.rename(path(a), path(b)):
            raise OSError(f"cannot rename {a} to {b}")

    held = fs.exists(path(base))
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
        write_manifest(manifest, f"{stage}/manifest")
        if held:
            move(base, aside)
        move(stage, base)
    except Exception:
        if held and fs.exists(path(aside)) and not fs.exists(path(base)):
            move(aside, base)
        fs.delete(path(stage), True)
        raise
    fs.delete(path(aside), True)


def is_published(spark: SparkSession, target: str) -> bool:
    fs, path = _fs(spark, target)
    return fs.exists(path(f"{target}/manifest/_SUCCESS"))


def is_stale(spark: SparkSession, target: str, digest: str) -> bool:
    """Whether the published set is absent or was made from other content."""
    return not is_published(spark, target) or spark.read.json(f"{target}/manifest").first().digest != digest
