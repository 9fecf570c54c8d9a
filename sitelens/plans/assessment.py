"""Evidence to findings to explanation for many projects in one plan, with typed stage results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import rules
from sitelens.operators import assessment, evidence, explanation


@dataclass
class Run:
    """Tables of a run by stage; a stage that failed has its error class in ``errors`` and no table."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def stage(self, name: str, make: Callable[[], DataFrame], *needs: str) -> None:
        """Plans a stage; a failure, or a missing input, leaves earlier stages as they are."""
        if any(n not in self.tables for n in needs):
            self.errors[name] = "UpstreamMissing"
            return
        try:
            table = make()
            table.schema  # noqa: B018  resolves the plan
            self.tables[name] = table
        except Exception as e:  # noqa: BLE001  stage failures are results, not crashes
            self.errors[name] = type(e).__name__

    @property
    def status(self) -> str:
        return "PARTIAL" if self.errors else "COMPLETE"


def assess(records: DataFrame) -> Run:
    """``records`` as evidence rows (see ``catalog.evidence.records``) through all stages."""
    run, t = Run(), {}
    t = run.tables
    run.stage("records", lambda: records)
    run.stage("contradictions", lambda: evidence.contradictions(t["records"]), "records")
    run.stage("dependencies", lambda: evidence.dependencies(t["records"]), "records")
    run.stage("reviews", lambda: evidence.reviews(_requests(t["records"])), "records")
    run.stage("annotated", lambda: evidence.annotated(t["records"], t["dependencies"], t["contradictions"], t["reviews"]), "dependencies", "contradictions", "reviews")
    run.stage("findings", lambda: assessment.numbered(assessment.findings(_assessable(t["records"]))), "records")
    run.stage("finding_reviews", lambda: assessment.review_requests(t["findings"]), "findings")
    run.stage("themes", lambda: explanation.themes(_unknowns(t["findings"])), "findings")
    run.stage("summary", lambda: explanation.result_summary(t["findings"], "project_id"), "findings")
    run.stage("gate", lambda: evidence.needs_human_review(t["findings"].select("project_id", F.when(F.col("human_review_required"), "REQUIRED").otherwise("NONE").alias("status"))), "findings")
    return run


def _requests(records: DataFrame) -> DataFrame:
    return records.where("state = 'UNKNOWN'").select("project_id", "domain", F.col("note").alias("reason"), F.lit("MATERIAL").alias("severity"), "evidence_id")


def _assessable(records: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in ("created_by", "source_trust", "source_class", "document_status")} | {"deterministic": F.lit(False)}
    return records.select(
        "project_id",
        "domain",
        "evidence_id",
        "state",
        F.lower(F.concat_ws(" ", "field_name", "note")).alias("text"),
        rules.is_authoritative(cols).alias("authoritative"),
        rules.is_deterministic(cols).alias("deterministic"),
        rules.is_project_document(cols).alias("project_document"),
    )


def _unknowns(found: DataFrame) -> DataFrame:
    return found.where("status = 'UNKNOWN'").select("project_id", F.col("finding_id").alias("item_id"), F.concat(F.lower("domain"), F.lit(" evidence")).alias("text"), "domain")
