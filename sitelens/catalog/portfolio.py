"""Portfolio and comparison queries over events as runs and derived snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog.base import pick, sql_pick, table
from sitelens.functions import constants as K
from sitelens.operators import diff, portfolio

_STATUS = {"click": "COMPLETE", "purchase": "COMPLETE", "error": "FAILED", "signup": "REQUIRES_HUMAN_REVIEW", "view": "PARTIAL"}
STATES = ("CLEAR", "UNKNOWN", "CONDITIONAL", "CONSTRAINED", "INFORMATIONAL")
DOMAINS = (*K.DOMAIN_ORDER, "EU_REPORTING")


def runs(spark: SparkSession, d: str) -> DataFrame:
    from sitelens.functions.rules import mapped

    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), mapped(F.col("event_type"), _STATUS).alias("workflow_status"), F.round("value", 6).alias("power"), "props")


_RUNS = "select user_id as project_id, event_id as run_id, ts as created_at, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _STATUS.items()) + " end as workflow_status, round(value, 6) as power, props from events"


def project_list(spark, d):
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"))
    return portfolio.project_list(projects, portfolio.storable(runs(spark, d))).select("project_id", "project_name", "run_count", "latest_run_id")


def runs_newest_first(spark, d):
    return portfolio.newest_first(runs(spark, d)).select("project_id", "run_id", "position")


def successful_runs_only(spark, d):
    return portfolio.storable(runs(spark, d)).select("run_id", "workflow_status", "power")


def flatten_json_paths(spark, d):
    k = F.col("event_id")
    doc = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "site": {"name": "s'), (k % 9).cast("string"), F.lit('", "at": {"x": '), (k % 100).cast("string"), F.lit('}}, "tags": [1, 2]}'))
    return diff.flatten_paths(table(spark, d, "events").select("event_id", doc.alias("doc")), "doc", "event_id")


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    before = c.where(k % 11 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    after = c.where(k % 7 != 0).select(
        k.alias("id"),
        F.when(k % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise(F.round("c_acctbal", 2)).alias("balance"),
    )
    return before, after


def snapshot_diff(spark, d):
    return diff.section_diff(*_snapshots(spark, d), "id", ("segment", "nation", "balance"))


_DIFF = (
    "b as (select c_custkey as id, c_mktsegment as segment, c_nationkey as nation, round(c_acctbal, 2) as balance, true as has from customer where c_custkey % 11 <> 0), "
    "a as (select c_custkey as id, case when c_custkey % 5 = 0 then 'MOVED' else c_mktsegment end as segment, c_nationkey as nation, case when c_custkey % 3 = 0 then null else round(c_acctbal, 2) end as balance, true as has from customer where c_custkey % 7 <> 0), "
    "j as (select coalesce(b.id, a.id) as id, b.has as hb, a.has as ha, concat_ws(',', case when b.segment is distinct from a.segment then 'segment' end, case when b.nation is distinct from a.nation then 'nation' end, "
    "case when b.balance is distinct from a.balance then 'balance' end) as cf from b full join a on a.id = b.id), "
    "df as (select id, case when hb is null then 'added' when ha is null then 'removed' when cf <> '' then 'changed' else 'unchanged' end as change_kind, case when hb and ha then cf else '' end as changed_fields from j)"
)


def diff_summary(spark, d):
    return diff.diff_summary(snapshot_diff(spark, d), "projects")


def findings(spark, d) -> DataFrame:
    """Line items as findings: order, domain and status follow their keys."""
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", pick(DOMAINS, F.col("l_partkey")).alias("domain"), pick(STATES, F.col("l_suppkey") + F.col("l_linenumber")).alias("status"))


_FINDINGS = f"select l_orderkey as run_id, l_linenumber, {sql_pick(DOMAINS, 'l_partkey')} as domain, {sql_pick(STATES, 'l_suppkey + l_linenumber')} as status from lineitem"


def domain_transition(spark, d):
    f = findings(spark, d)
    before, after = f.where("l_linenumber % 2 = 1"), f.where("l_linenumber % 2 = 0")
    return diff.domain_transitions(diff.group_states(before, "run_id"), diff.group_states(after, "run_id"), "run_id")


_GROUP = "case " + " ".join(f"when domain in ({', '.join(repr(m) for m in members)}) then '{key}'" for key, members in K.DOMAIN_GROUPS) + " else lower(domain) end"
_PRIORITY = "case status " + " ".join(f"when '{s}' then {p}" for s, p in K.STATE_PRIORITY.items()) + " else 3 end"


def default_compare_pair(spark, d):
    return portfolio.default_pair(runs(spark, d))


QUERIES = {
    "q43_project_list": project_list,
    "q44_runs_newest_first": runs_newest_first,
    "q45_successful_runs_only": successful_runs_only,
    "q46_flatten_json_paths": flatten_json_paths,
    "q47_snapshot_diff": snapshot_diff,
    "q48_diff_summary": diff_summary,
    "q49_domain_transition": domain_transition,
    "q67_default_compare_pair": default_compare_pair,
}

SQL = {
    "q43_project_list": f"with r as (select * from ({_RUNS}) where workflow_status in ('COMPLETE', 'REQUIRES_HUMAN_REVIEW')) "
    "select c_custkey as project_id, c_name as project_name, count(run_id) as run_count, arg_max(run_id, (created_at, run_id)) as latest_run_id from customer left join r on project_id = c_custkey group by all",
    "q44_runs_newest_first": f"select project_id, run_id, row_number() over (partition by project_id order by created_at desc, run_id desc)::int as position from ({_RUNS})",
    "q45_successful_runs_only": f"select run_id, workflow_status, power from ({_RUNS}) where workflow_status in ('COMPLETE', 'REQUIRES_HUMAN_REVIEW')",
    "q46_flatten_json_paths": "with k as (select event_id, 'props.' || unnest(json_keys(props)) as path, props from events) select event_id, path, json_extract(props, '$.' || substr(path, 7))::varchar as value from k "
    "union all select event_id, 'site.name', '\"s' || (event_id % 9) || '\"' from events union all select event_id, 'site.at.x', (event_id % 100)::varchar from events union all select event_id, 'tags', '[1,2]' from events",
    "q47_snapshot_diff": f"with {_DIFF} select * from df",
    "q48_diff_summary": f"with {_DIFF} select 'projects' as section, change_kind, count(*) as n from df group by change_kind",
    "q49_domain_transition": f"with f as (select *, {_GROUP} as domain_group, {_PRIORITY} as p from ({_FINDINGS})), "
    "b as (select run_id, domain_group, arg_max(status, (p, status)) as previous from f where l_linenumber % 2 = 1 group by all), a as (select run_id, domain_group, arg_max(status, (p, status)) as current from f where l_linenumber % 2 = 0 group by all), "
    "j as (select run_id, domain_group, coalesce(previous, 'NOT_ASSESSED') as previous, coalesce(current, 'NOT_ASSESSED') as current from b full join a using (run_id, domain_group)) "
    "select *, case when previous = current then 'UNCHANGED' when previous = 'NOT_ASSESSED' then case when current in ('CONDITIONAL', 'CONSTRAINED') then 'NEW_CONSTRAINT' else 'NEW_DOMAIN' end "
    "when current = 'NOT_ASSESSED' then 'NO_LONGER_PRESENT' else 'CHANGED' end as change_kind from j",
    "q67_default_compare_pair": f"with p as (select *, row_number() over (partition by project_id order by created_at desc, run_id desc) as k from ({_RUNS})) "
    "select project_id, max(case when k = 2 then run_id end) as baseline_run_id, max(case when k = 1 then run_id end) as comparison_run_id from p where k <= 2 group by project_id having count(*) = 2",
}
