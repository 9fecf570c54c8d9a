"""The first records of each query by blocks are those of all pairs, whatever the vectors hold."""

from __future__ import annotations

import pytest

from sitelens.catalog import search
from sitelens.operators import lexical, vectors

NAN, INF = float("nan"), float("inf")


def tables(spark):
    rows = [(i, [float(i % 7), float(i % 3) - 1, 0.5]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [NAN, 0.0, 1.0]), (105, [INF, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (106, [1e9, 1e-9, 3.0])]
    asked = [("a", [1.0, 2.0, 3.0]), ("b", [0.0, 0.0, 0.0]), ("c", None), ("d", [NAN, 1.0, 1.0]), ("e", [1.0, 1.0]), ("f", [1.0, None, 1.0]), ("g", [INF, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), ("h", [])]
    return spark.createDataFrame(rows, "id long, vector array<float>"), spark.createDataFrame(asked, "qid string, q array<float>")


@pytest.mark.parametrize("k", [1, 5, 60])
def test_blocks_find_what_all_pairs_do(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 9)
    held, asked = tables(spark)
    # NaN is not equal to itself, so rows are compared as text.
    rows = lambda scores: sorted(map(str, lexical.ranked(scores, k).collect()))
    assert rows(vectors.nearest(held, asked, k)) == rows(vectors.cosine(held, asked))


def test_empty_sides(spark):
    held, asked = tables(spark)
    assert vectors.nearest(held.limit(0), asked, 3).count() == 0 and vectors.nearest(held, asked.limit(0), 3).count() == 0


def test_queries_do_not_sort_all_pairs(spark):
    """Each of these searches joined every record to every query and sorted the pairs of a task."""
    d = "/root/testdata/sf0.001"
    for query in (search.cosine_topk, search.rrf_fusion, search.hybrid_search, search.comparison_candidates):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "zip_with(vector" not in plan
