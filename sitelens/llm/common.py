"""Shared helpers: scratch tables in the shared folder, document keys, connected components."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Rows whose id's crc32 leaves remainder 0 by this are held out.
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine
    is set instead, but only if the master is local: executors elsewhere would not see it.
    """
    found = spark.conf.get(_CONF, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitelens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sitelens/{name}-{uuid.uuid4().hex}"


#: The driver's heap is given back after so many written tables: their plans are garbage by then, and the heap would grow to its limit.
TABLES_A_RELEASE = 4
_written = itertools.count(1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage and survives lost executors: a retried task reads the written table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if next(_written) % TABLES_A_RELEASE == 0:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def private(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in itertools.count() if (n := f"_{name}" + (f"_{i}" if i else "")) not in taken)


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote, once nothing reads it any more."""
    path = vars(df).get("_stored_at")
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver forget finished jobs, so that the executors delete their shuffle files now and not at some later time, and
    give back memory that nothing uses: the heap shrinks, and what compilers and plans of hundreds of jobs have freed outside of it
    goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """The Java machine's own command ``System.trim_native_heap``; machines that lack it keep their memory."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
        # By the interface: the object's own class is closed to callers.
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 (null ids: true, they never teach)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def row_keys(*cols: str) -> tuple[Column, Column]:
    """128 bits as two longs that identify a row by the given columns (nulls count as values)."""
    marked = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*marked), F.xxhash64(F.lit(7), *marked)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` is a ``u``: then each ``v`` is its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return node.where("child > 1 or (child = 1 and parent = 1)").isEmpty()


def connected_components(edges: DataFrame, name: str = "cc", known: DataFrame | None = None) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``; the component is its least node.

    Alternating large-star and small-star rounds over DataFrames, until only stars are left. Both sides of each join are
    written tables, so a hub's rows are split by AQE's skew join; minima pre-aggregate before
    they shuffle. Nothing is gathered on the driver but a flag a round. ``known`` are the components of earlier edges:
    then only edges between those take part.
    """
    if known is not None:
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        edges = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    while not _stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = stored(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            name,
        )
        least2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = large.join(least2, "u")
        small = (
            joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = stored(small, name)
        for t in (now, least, large, least2):
            discard(t)
        now = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    members = members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if known is None:
        return members
    moved = members.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    older = known.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = members.join(known.select("node"), "node", "left_anti")
    return older.union(fresh)
