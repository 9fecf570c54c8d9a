"""Projects and runs: append-only runs, derived latest pointers, lists, default comparison pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.constants import STORED_STATUSES
from sitelens.sources import versions
from sitelens.staging import staged


def storable(runs: DataFrame, status: str = "workflow_status") -> DataFrame:
    """Only complete runs and those that wait for human review are stored."""
    return runs.where(F.col(status).isin(*STORED_STATUSES))


def append_runs(runs: DataFrame, path: str) -> int:
    """Commits storable runs and the latest run of each of their projects as one version; earlier runs never change."""
    spark, own = runs.sparkSession, staged(storable(runs), "runs")
    return versions.commit(spark, path, append={"runs": own, "latest": latest_runs(own)})


def stored_runs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return versions.read(spark, path, "runs", version)


def latest_pointers(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``project_id, run_count, latest_run_id, latest_at`` of each project from the pointers alone; the runs are not read."""
    top = F.max(F.struct("latest_at", "latest_run_id")).alias("t")
    held = versions.read(spark, path, "latest", version).groupBy("project_id").agg(F.sum("run_count").alias("run_count"), top)
    return held.select("project_id", "run_count", "t.latest_run_id", "t.latest_at")


def latest_runs(runs: DataFrame, by: str = "project_id", at: str = "created_at", run: str = "run_id") -> DataFrame:
    """Run count and latest run of each project; an aggregate, so hot projects combine before the shuffle."""
    top = F.max(F.struct(at, run)).alias("t")
    return runs.groupBy(by).agg(F.count("*").alias("run_count"), top).select(by, "run_count", F.col(f"t.{run}").alias("latest_run_id"), F.col(f"t.{at}").alias("latest_at"))


def project_list(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """All projects with their latest run and count; projects without runs count 0."""
    return projects.join(latest_runs(runs), "project_id", "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def newest_first(runs: DataFrame, by: str = "project_id", at: str = "created_at", run: str = "run_id") -> DataFrame:
    return runs.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(run))))


def default_pair(runs: DataFrame) -> DataFrame:
    """Second newest run as baseline, newest as compared; projects with one run have none."""
    two = newest_first(runs).where("position <= 2")
    wide = two.groupBy("project_id").agg(
        F.max(F.when(F.col("position") == 2, F.col("run_id"))).alias("baseline_run_id"), F.max(F.when(F.col("position") == 1, F.col("run_id"))).alias("comparison_run_id")
    )
    return wide.where(F.col("baseline_run_id").isNotNull() & (F.col("baseline_run_id") != F.col("comparison_run_id")))


def by_either_id(runs: DataFrame, key: str) -> DataFrame:
    return runs.where((F.col("run_id").cast("string") == key) | (F.col("external_run_id") == key))


def upsert(current: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of both by key, the later of two winning."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    top = F.max_by(F.struct(*rest), F.col(at)).alias("t")
    return both.groupBy(key).agg(top).select(key, "t.*")


def project_key(context) -> F.col:
    """Twelve hex digits of the canonical JSON of a project's fields."""
    return F.substring(F.sha2(F.to_json(context), 256), 1, 12)
