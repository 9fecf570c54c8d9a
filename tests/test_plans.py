"""Whole plans, the driver entry and its guard, and plan shapes."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from sitelens.catalog import evidence as cat_evidence
from sitelens.catalog import search as cat_search
from sitelens.catalog.base import policy_records, table
from sitelens.operators import lexical
from sitelens.plans import assessment as plan_assessment
from sitelens.plans import search as plan_search

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_search_never_returns_ineligible_records(spark):
    docs = table(spark, DIR, "documents")
    records = policy_records(docs)
    index = lexical.build_index(records, "id", "text")
    queries = spark.createDataFrame([("q", cat_search.PLAIN_QUERY)], "qid string, query string")
    hits = plan_search.search(records, index, queries, cat_search._record(), cat_search._request()).collect()
    held = {r.id: r for r in records.collect()}
    assert hits and all(held[h.id].eligible and held[h.id].source_class not in ("ARCHIVE", "RESTRICTED", "GOVERNANCE", "SUPPORTING_INDUSTRY") for h in hits)
    assert [h.rank for h in sorted(hits, key=lambda h: h.rank)] == list(range(1, len(hits) + 1))


def test_repartitioning_does_not_change_results(spark):
    docs = table(spark, DIR, "documents")
    queries = spark.createDataFrame([("q", cat_search.PLAIN_QUERY)], "qid string, query string")
    one, two = (sorted(map(tuple, lexical.bm25(lexical.build_index(d, "doc_id", "text"), queries).collect())) for d in (docs, docs.repartition(7).orderBy(F.desc("doc_id"))))
    assert one == two


def test_assessment_run(spark):
    run = plan_assessment.assess(cat_evidence.records(spark, DIR))
    assert run.status == "COMPLETE" and not run.errors
    assert run.tables["findings"].count() > 0 and run.tables["summary"].count() == run.tables["gate"].count()
    ids = [r.finding_id for r in run.tables["findings"].limit(5).collect()]
    assert all(i.startswith("assessment-") for i in ids)


def test_failed_stage_keeps_the_others(spark):
    run = plan_assessment.assess(cat_evidence.records(spark, DIR).drop("note"))
    assert run.status == "PARTIAL" and "findings" in run.errors and run.errors["summary"] == "UpstreamMissing" and "dependencies" in run.tables


def test_scans_are_pruned(spark):
    df = cat_search.document_frequency_idf(spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    reads = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert reads and all("lang" not in x and "source" not in x for x in reads)


def test_entry_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "sitelens", tmp_path / "sitelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
