"""Hilbert-curve sharding (operator 11).

Several metadata dimensions are quantised to ``2**bits`` cells each, by the quantiles of all rows: a value's cell
is the share of rows with smaller values. Cells keep the order of values, so ranges can be pruned, and a value that
holds a third of all rows is one cell. Rows are sorted by the Hilbert index of their cells, and the sorted rows are cut
into runs, the shards. Neighbours on the curve differ by one step in one dimension, so a shard covers a compact box, and a
filter on any of the dimensions skips most shards by the least and greatest values in the manifest.

Runs are cut by ``law``: ``rows`` gives shards whose counts differ by one at most, ``bytes`` shards of near equal
size (each cut is at most half a document from its place).

Dimensions are integers, dates, timestamps or strings; others raise ``TypeError``. Defined results: a null is less than
any other value; a null text has no bytes and size 1; rows equal in curve index, id and text lie next to each other in any order;
rows that repeat are all kept; an empty table gives no rows. Columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType

from sitelens.llm.common import discard, private, stored
from sitelens.llm.prefixsum import prefix_sums

SHARDS = 16
#: Bits of a dimension; bits times dimensions stay below 63.
BITS = 6
LAWS = ("rows", "bytes")


def text_size(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text and one more."""
    return (F.octet_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))) + 1).cast("long")


def _sortable(column: Column, kind: DataType) -> Column:
    """A string that sorts by bytes as the values do, nulls first."""
    if isinstance(kind, StringType):
        return F.coalesce(F.concat(F.lit("s"), column), F.lit(""))
    if isinstance(kind, DateType):
        column = F.unix_date(column)
    elif isinstance(kind, TimestampType | TimestampNTZType):
        column = F.unix_micros(column.cast("timestamp"))
    elif not isinstance(kind, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"a dimension of type {kind.simpleString()} has no cells")
    shifted = column.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.coalesce(F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0"), F.lit(""))


def cell_edges(keys: DataFrame, dims: Sequence[str], bits: int = BITS) -> dict[str, tuple[list[str], list[int]]]:
    """Per dimension the least key of each cell in use, and the cells; at most ``2**bits`` of them."""
    values = keys.select(F.explode(F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))])).alias("dim", "key"))
    counted = values.groupBy("dim", "key").agg(F.count("*").alias("n"))
    before = prefix_sums(counted, ["dim", "key"], {"before": "n"}, "hilbert-values")
    total = keys.count()
    place = {d: i for i, d in enumerate(sorted(dims))}
    ahead = F.col("before") - F.create_map(*[x for d in dims for x in (F.lit(d), F.lit(place[d] * total))])[F.col("dim")]
    cell = F.floor(ahead * F.lit(1 << bits) / F.lit(max(total, 1))).cast("int")
    edges = before.select("dim", "key", cell.alias("cell")).groupBy("dim", "cell").agg(F.min("key").alias("key")).collect()
    discard(before)
    out = {}
    for d in dims:
        own = sorted((e.cell, e.key) for e in edges if e.dim == d)
        out[d] = [k for _, k in own], [c for c, _ in own]
    return out


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of the points ``axes[dimension, row]``, each below ``2**bits``."""
    x = axes.astype(np.int64)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(d):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= ((x[d - 1] >> level) & 1) * ((1 << level) - 1)
    x ^= flips
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def curve_column(edges: Mapping[str, tuple[list[str], list[int]]], dims: Sequence[str], bits: int):
    """The Hilbert index as a function of the dimensions' sortable keys."""
    tables = [(np.array(edges[d][0], object), np.array(edges[d][1], np.int64)) for d in dims]

    def index(frame: pd.DataFrame) -> pd.Series:
        axes = []
        for i, (least, cells) in enumerate(tables):
            place = np.searchsorted(least, frame.iloc[:, i].to_numpy(object), side="right") - 1
            axes.append(cells[np.maximum(place, 0)])
        return pd.Series(hilbert_index(np.array(axes), bits))

    return F.pandas_udf(index, "long")


def sharded(
    rows: DataFrame,
    dims: Sequence[str],
    size: str,
    ties: Sequence[str] = (),
    shards: int = SHARDS,
    law: str = "rows",
    bits: int = BITS,
    names: tuple[str, str, str] = ("shard", "slot", "curve"),
) -> DataFrame:
    """``rows`` with their shard, their place in it and their index on the curve, in columns of the given ``names``.

    All columns travel through the one sort, so a caller that needs few of them selects these first. ``ties`` order rows
    of one index; ``size`` is the column that the law ``bytes`` evens out.
    """
    if law not in LAWS:
        raise ValueError(f"law {law!r} is none of {LAWS}")
    if not 0 < bits * len(dims) < 63:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits do not fit an index of 62 bits")
    shard, slot, curve = names
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    keys = rows.select(*[_sortable(F.col(d), kinds[d]).alias(f"d{i}") for i, d in enumerate(dims)])
    keyed = [f"d{i}" for i in range(len(dims))]
    edges = cell_edges(keys, keyed, bits)
    tie, one, rank, before = (private(rows, n) for n in ("tie", "one", "rank", "before"))
    frame = F.struct(*[_sortable(F.col(d), kinds[d]).alias(f"d{i}") for i, d in enumerate(dims)])
    curved = rows.withColumn(curve, curve_column(edges, keyed, bits)(frame))
    # Rows equal in all that orders them are told apart by their place in the input, so that they can be dealt to several tasks.
    curved = curved.withColumns({tie: F.monotonically_increasing_id(), one: F.lit(1).cast("long")})
    placed = prefix_sums(curved, [curve, *ties, tie], {rank: one, before: size}, "hilbert-order")
    if law == "rows":
        n = max(placed.count(), 1)
        cut = placed.withColumn(shard, F.expr(f"cast({rank} * {shards} div {n} as int)"))
    else:
        total = max(placed.agg(F.sum(size)).first()[0] or 1, 1)
        middle = F.col(before).cast("decimal(38,0)") * 2 + F.col(size)
        cut = placed.withColumn(shard, F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int"))
    first = private(cut, "first")
    starts = cut.groupBy(shard).agg(F.min(rank).alias(first))  # a row a shard
    return cut.join(F.broadcast(starts), shard).withColumn(slot, F.col(rank) - F.col(first)).select(*rows.columns, shard, slot, curve)


def write_shards(documents: DataFrame, path: str, dims: Sequence[str], size: str | None = None, text: str = "text", **options) -> DataFrame:
    """Writes ``documents`` into folders ``_shard=K`` under ``path``, in curve order, and gives the manifest: per shard its rows,
    bytes, and the least and greatest value and the nulls of each dimension."""
    sized, names = private(documents, "bytes"), ("_shard", "_slot", "_curve")
    rows = documents.withColumn(sized, F.col(size).cast("long") if size else text_size(text))
    out = sharded(rows, dims, sized, names=names, **options)
    stats = [x for i, d in enumerate(dims) for x in (F.min(d).alias(f"min_{i}"), F.max(d).alias(f"max_{i}"), F.count_if(F.col(d).isNull()).alias(f"nulls_{i}"))]
    out = stored(out, "hilbert-shards")
    # A shard's rows are dealt by their slots, so that a large shard is several files, each a run of the curve.
    files = out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop(sized)
    files.write.partitionBy("_shard").parquet(f"{path}/data")
    manifest = out.groupBy("_shard").agg(F.count("*").alias("rows"), F.sum(sized).alias("bytes"), *stats)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")  # a row a shard
    discard(out)
    return documents.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, dims: Sequence[str], where: Mapping[str, tuple]) -> DataFrame:
    """The documents with ``low <= dimension <= high`` for each ``dimension: (low, high)`` (None: open), from the shards whose
    box in the manifest meets the filter; the others' files are not listed for reading."""
    wanted, keep = F.lit(True), F.lit(True)
    for d, (low, high) in where.items():
        i = list(dims).index(d)
        for bound, edge, exact in ((low, F.col(f"max_{i}") >= F.lit(low), F.col(d) >= F.lit(low)), (high, F.col(f"min_{i}") <= F.lit(high), F.col(d) <= F.lit(high))):
            if bound is not None:
                wanted, keep = wanted & edge, keep & exact
    hit = [r["_shard"] for r in spark.read.parquet(f"{path}/manifest").where(wanted).select("_shard").collect()]
    return spark.read.parquet(f"{path}/data").where(F.col("_shard").isin(hit)).where(keep)


def document_shards(documents: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` of every document, sharded by language, source and size."""
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    slim = stored(slim, "hilbert-documents")
    out = sharded(slim, ("lang", "source", "size"), "size", ("doc_id", "text_crc32"), shards, law)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
