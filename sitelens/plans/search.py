"""Hybrid search as one plan: index, rank, fuse, filter, group."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from sitelens.functions import rules
from sitelens.operators import lexical, retrieval, vectors


@dataclass
class Limits:
    """How many hits each authority group may return."""

    authoritative: int = 5
    historical: int = 3
    curated: int = 3
    supporting: int = 3

    def table(self) -> dict[str, int]:
        return {g: getattr(self, g) for g in rules.GROUP_ORDER}


def search(
    records: DataFrame,
    index: lexical.LexicalIndex,
    queries: DataFrame,
    record: Mapping[str, Column],
    request: Mapping[str, Column],
    query_vectors: DataFrame | None = None,
    record_vectors: DataFrame | None = None,
    limits: Limits | None = None,
    top_k: int = 10,
) -> DataFrame:
    """Grouped hits of many queries at once.

    Statistics are those of the whole index; the eligibility predicate is applied to candidates before they are cut, so
    an ineligible record never takes an eligible one's place. Without vectors the fusion is of the lexical ranks alone.
    """
    allowed = records.where(rules.eligible(record, request)).select("id")
    limit = lexical.candidate_limit(top_k)
    lex = lexical.ranked(lexical.bm25(index, queries).join(allowed, "id", "left_semi"), limit)
    if query_vectors is not None and record_vectors is not None:
        sem = lexical.ranked(vectors.nearest(record_vectors.join(allowed, "id", "left_semi"), query_vectors, limit), limit)
    else:
        sem = lex.limit(0)
    facts = records.select("id", "document_id", "source_class", "document_status")
    return retrieval.grouped_hits(retrieval.fuse(lex, sem).join(facts, "id"), (limits or Limits()).table())
