"""Plans whose memory or time grew faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import assessment, explanation, lexical, repair
from tests.test_repair import BOWTIE, SQUARE, layer


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_dealt_before_they_are_repaired(spark):
    """A layer in one file was opened into edges, joined and written by one task."""
    zones = layer(spark, [SQUARE], [BOWTIE], [SQUARE]).coalesce(1)
    out = repair.repaired(zones, "ZONE_ID")
    assert "REPARTITION_BY_NUM" in plan(out) and out.rdd.getNumPartitions() > 1
    assert {r.ZONE_ID: r.geometry_state for r in out.collect()} == {r.ZONE_ID: "REPAIRED" if i == 1 else "VALID" for i, r in enumerate(sorted(zones.collect()))}


def test_overlap_search_deals_chunks_by_their_pairs(spark, monkeypatch):
    chunks = spark.range(60).select("id", F.concat_ws(" ", F.lit("the"), (F.col("id") % 5).cast("string"), F.lit("road")).alias("text"))
    asked = spark.createDataFrame([("a", "The road 3"), ("b", "nothing"), ("c", "1 THE")], "qid string, query string")
    want = sorted(map(tuple, lexical.overlap_search(chunks, asked, 4).collect()))
    assert want[:2] == [("a", 3, 3, 1), ("a", 8, 3, 2)] and [r[:3] for r in want if r[0] == "c"] == [("c", 1, 2), ("c", 6, 2), ("c", 11, 2), ("c", 16, 2)]
    monkeypatch.setattr(lexical, "PAIRS", 10)
    found = lexical.overlap_search(chunks, asked, 4)
    assert "hashpartitioning(id" in plan(found) and ", 18), REPARTITION_BY_NUM" in plan(found)
    assert sorted(map(tuple, found.collect())) == want


def test_findings_hold_each_id_once(spark):
    """Ten sets of ids were held for each group; an id of two records is in the sets of both."""
    rows = [
        ("p", "GRID", "e2", "UNKNOWN", "mic not confirmed", True, False, False),
        ("p", "GRID", "e1", "PROVIDED", "nearest asset agreement", False, True, False),
        ("p", "GRID", "e2", "PROVIDED", "agreement", False, False, True),
        ("p", "GRID", None, "UNKNOWN", None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "project_id string, domain string, evidence_id string, state string, text string, authoritative boolean, deterministic boolean, project_document boolean")
    held = assessment._held(records)
    assert plan(held).count("partial_collect_set") == 1
    got = held.first()
    assert (got.all_ids, got.unknown_ids, got.document_ids, got.authoritative_ids, got.agreement_ids, got.context_ids, got.explicit_ids) == (["e1", "e2"], ["e2"], ["e2"], ["e2"], ["e1", "e2"], ["e1"], [])
    assert got.any_deterministic is True and got.energised is False


def test_source_summary_counts_in_one_pass(spark):
    """Records were counted by label, and joined to all labels of each run."""
    rows = spark.createDataFrame([(1, "RAG_RETRIEVAL", "PRIMARY"), (1, "DETERMINISTIC_GIS", "PRIMARY"), (1, "RAG_RETRIEVAL", "CURATED"), (2, "PROJECT_DOCUMENT", "PRIMARY")], "run long, created_by string, source_class string")
    out = explanation.source_summary(rows, "run")
    assert "Join" not in plan(out)
    got = {(r.run, r.label): r.n for r in out.collect()}
    assert got[1, "Authoritative Policy"] == 2 and got[2, "Authoritative Policy"] == 0 and sum(got.values()) == 4 and len(got) == 2 * len({k for _, k in got})
