"""Commits appear at once: failed writes, two writers, readers of older versions, runs with their pointers, index states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelens.operators import lexical, portfolio
from sitelens.sources import versions


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_failed_write_leaves_the_set_as_it_was(spark, tmp_path):
    target = f"file://{tmp_path}/set"
    with pytest.raises(versions.NoVersion):
        versions.read(spark, target, "a")
    assert versions.commit(spark, target, {"a": spark.range(3), "b": spark.range(2)}) == 0
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        versions.commit(spark, target, {"a": spark.range(9), "b": broken})
    # The first table of the failed set is written, and nobody reads it.
    assert versions.versions(spark, target) == [0] and ids(versions.read(spark, target, "a")) == [0, 1, 2] and ids(versions.read(spark, target, "b")) == [0, 1]

    def refuse(now):
        raise RuntimeError(f"not after {now['version']}")

    with pytest.raises(RuntimeError, match="not after 0"):
        versions.commit(spark, target, {"a": spark.range(9)}, check=refuse)
    assert versions.commit(spark, target, {"a": spark.range(1)}, {"b": spark.range(2, 4)}, {"why": "more"}) == 1
    assert ids(versions.read(spark, target, "a")) == [0] and ids(versions.read(spark, target, "b")) == [0, 1, 2, 3]
    assert ids(versions.read(spark, target, "a", 0)) == [0, 1, 2] and versions.state(spark, target)["properties"] == {"why": "more"}
    assert len(versions.clean(spark, target, keep=1)) == 4
    assert versions.versions(spark, target) == [1] and ids(versions.read(spark, target, "b")) == [0, 1, 2, 3]


def test_of_two_writers_both_are_kept(spark, tmp_path):
    target = f"file://{tmp_path}/set"
    versions.commit(spark, target, {"a": spark.range(1)})
    seen = []

    def other_comes_first(now):
        seen.append(now["version"])
        if len(seen) == 1:
            versions.commit(spark, target, append={"a": spark.range(10, 11)})

    assert versions.commit(spark, target, append={"a": spark.range(20, 21)}, check=other_comes_first) == 2
    assert seen == [0, 1] and ids(versions.read(spark, target, "a")) == [0, 10, 20]


def test_runs_and_their_pointers_are_one_commit(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/runs"
    runs = lambda *rows: spark.createDataFrame(rows, "project_id long, run_id long, created_at long, workflow_status string")
    portfolio.append_runs(runs((1, 10, 5, "COMPLETE"), (1, 11, 6, "FAILED"), (2, 20, 1, "REQUIRES_HUMAN_REVIEW")), target)
    portfolio.append_runs(runs((1, 12, 4, "COMPLETE"), (2, 21, 9, "COMPLETE")), target)
    pointers = lambda: {r.project_id: (r.run_count, r.latest_run_id) for r in portfolio.latest_pointers(spark, target).collect()}
    assert pointers() == {1: (2, 10), 2: (2, 21)}
    assert pointers() == {r.project_id: (r.run_count, r.latest_run_id) for r in portfolio.latest_runs(portfolio.stored_runs(spark, target)).collect()}
    monkeypatch.setattr(versions, "_create", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        portfolio.append_runs(runs((3, 30, 1, "COMPLETE")), target)
    assert set(pointers()) == {1, 2} and portfolio.stored_runs(spark, target).count() == 4


def test_index_versions_and_states(spark, tmp_path):
    target = f"file://{tmp_path}/index"
    records = spark.createDataFrame([(1, "grid power"), (2, "water")], "id long, text string")
    state = lambda digest, vectors=False: lexical.index_state(spark, target, digest, 2, vectors)
    assert state("d1") == "MISSING"
    lexical.write_index(lexical.build_index(records, "id", "text"), target, 2, digest="d1")
    assert state("d1") == "READY" and state("d2") == "STALE" and state("d1", True) == "INCOMPLETE"
    more = records.union(spark.createDataFrame([(3, "power")], records.schema))
    lexical.write_index(lexical.build_index(more, "id", "text"), target, 2, vectors=records.select("id", F.array(F.lit(1.0)).alias("v")), digest="d2")
    assert state("d2", True) == "READY" and lexical.read_index(spark, target).lengths.count() == 3
    assert lexical.read_index(spark, target, 0).lengths.count() == 2
