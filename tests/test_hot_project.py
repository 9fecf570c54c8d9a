"""One project with half of all records: rows in place of arrays say the same, and no task gathers the project."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import evidence


def records(spark):
    i = F.col("id")
    fields = F.array(*[F.lit(f) for f in ("project_scope", "grid_connection_agreement", "renewable_plan", "site_configuration", "note", "commissioning", "energisation_date")])
    project = F.when(i % 2 == 0, F.lit(0)).otherwise(i % 40)
    return spark.range(4000).select(
        project.cast("long").alias("project_id"),
        F.concat(F.lit("e"), (i % 1500).cast("string")).alias("evidence_id"),
        # Energisation and commissioning are known of the projects of every fifth number only.
        F.element_at(fields, F.when(project % 5 == 0, F.floor(i / 3) % 7).otherwise(F.floor(i / 3) % 5).cast("int") + 1).alias("field_name"),
        F.when(i % 11 > 0, F.concat(F.lit("v"), (project % 3 * F.floor(i / 97) % 4).cast("string"))).alias("value"),
        F.when(i % 13 == 0, "UNKNOWN").otherwise("PROVIDED").alias("state"),
    )


def test_rows_say_what_arrays_say(spark):
    rows = records(spark)
    listed = lambda df, *keys: sorted(map(tuple, df.select(*keys, F.explode("evidence_ids").alias("e")).collect()))
    plain = lambda df, *keys: sorted(map(tuple, df.select(*keys, "evidence_id").collect()))
    for arrays, links, keys in (
        (evidence.contradictions(rows), evidence.contradiction_links(rows), ("project_id", "field", "n_values")),
        (evidence.dependencies(rows), evidence.dependency_links(rows), ("project_id", "dependency_id", "domain")),
    ):
        want = listed(arrays, *keys)
        assert want and plain(links, *keys) == want
        assert "collect_" not in links._jdf.queryExecution().executedPlan().toString()
    asked = rows.select("project_id", F.lit("GRID").alias("domain"), F.concat(F.lit(" Reason  "), (F.length("value") % 2).cast("string")).alias("reason"), F.lit("MATERIAL").alias("severity"), "evidence_id").where("reason is not null")
    assert plain(evidence.review_links(asked), "project_id", "domain", "reason_key") == listed(evidence.reviews(asked), "project_id", "domain", "reason_key")
    assert evidence.contradiction_links(rows.limit(0)).count() == 0
