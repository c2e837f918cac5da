"""Correlation, graph, health and detail reports over the whole derived tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from causeway.functions import event_fields as ef
from causeway.operators import validation
from causeway.plans import detail, graph, health, incidents
from causeway.workload.lines import line_sql, lines, union
from causeway.workload.registry import Given, query
from causeway.workload import sql
from causeway.workload.sql import AS_OF, GROUP

_VIEW = ", ".join(incidents.VIEW_COLUMNS)


@query("d1_correlation", "SELECT test_result_id, dataset_urn, produced_urn, job_run_id FROM icv_all")
def correlation(g: Given):
    return incidents.correlated_runs(g.tables)


@query("d2_parents", """SELECT le.run_id AS job_run_id, le.dataset_urn AS produced_urn, jr.parent_run_id, p.job_name AS parent_job_name,
  p.current_state AS parent_job_status, jr.root_parent_run_id, r.job_name AS root_parent_job_name, r.completed_at AS root_parent_job_completed_at
  FROM edges le JOIN datasets d ON le.dataset_urn = d.dataset_urn JOIN runs jr ON le.run_id = jr.run_id
  LEFT JOIN runs p ON jr.parent_run_id = p.run_id LEFT JOIN runs r ON jr.root_parent_run_id = r.run_id WHERE le.edge_type = 'output'""")
def parents(g: Given):
    return incidents.with_parents(g.tables, incidents.producers(g.tables)).select(
        "job_run_id", "produced_urn", "parent_run_id", "parent_job_name", "parent_job_status", "root_parent_run_id",
        "root_parent_job_name", "root_parent_job_completed_at",
    )


@query("d3_incident_view", f"SELECT {_VIEW} FROM icv_all")
def incident_view(g: Given):
    return incidents.incident_view(g.tables)


@query("d4_resolution_state", """SELECT test_result_id, resolution_status, resolved_by, resolution_reason, mute_expires_at,
  resolution_updated_at FROM one_state""")
def resolution_state(g: Given):
    return incidents.with_resolution(g.tables, incidents.incident_keys(g.tables)).select(
        "test_result_id", "resolution_status", "resolved_by", "resolution_reason", "mute_expires_at", "resolution_updated_at"
    )


@query("b21_default_open", "SELECT test_result_id, coalesce(resolution_status, 'open') AS status FROM one_state")
def default_open(g: Given):
    found = incidents.with_resolution(g.tables, incidents.incident_keys(g.tables))
    return found.select("test_result_id", ef.resolution_or_open(F.col("resolution_status")).alias("status"))


@query("b19_correlation_status", f"""SELECT t.test_result_id, t.run_id, CASE WHEN o.job_run_id IS NULL AND t.dataset_urn NOT IN (SELECT dataset_urn FROM lonely)
  THEN 'unknown' WHEN t.dataset_urn IN (SELECT dataset_urn FROM lonely) AND o.job_run_id IS NOT NULL THEN 'orphan'
  WHEN o.job_run_id IS NULL THEN 'unknown' ELSE 'correlated' END AS correlation_status
  FROM tests t LEFT JOIN one o ON t.test_result_id = o.test_result_id WHERE t.status IN ('failed', 'error')""")
def correlation_status(g: Given):
    failing = incidents.failing_tests(g.tables).select("test_result_id", "test_run_id", "dataset_urn")
    made = incidents.latest_producers(incidents.producers(g.tables)).select("dataset_urn", "job_run_id")
    orphan = health.unproduced(g.tables).select("dataset_urn", F.lit(True).alias("is_orphan"))
    joined = failing.join(made, "dataset_urn", "left").join(orphan, "dataset_urn", "left")
    return joined.select(
        "test_result_id", F.col("test_run_id").alias("run_id"),
        ef.correlation_status(F.col("job_run_id").cast("string"), F.col("is_orphan")).alias("correlation_status"),
    )


_TRUE_FILTER = "job_status = 'FAIL' AND job_producer_name = 'airflow' AND test_executed_at > TIMESTAMP '2024-01-03' AND test_executed_at < TIMESTAMP '2024-01-28'"


@query("c6_view_filter", f"SELECT test_result_id, job_run_id FROM icv_all WHERE {_TRUE_FILTER}")
def view_filter(g: Given):
    wanted = incidents.IncidentFilter(
        job_status="FAIL", job_producer_name="airflow",
        executed_after=dt.datetime(2024, 1, 3), executed_before=dt.datetime(2024, 1, 28),
    )
    view = incidents.filter_tests(incidents.incident_view(g.tables), wanted)
    return incidents.filter_producers(view, wanted).select("test_result_id", "job_run_id")


_ACTIVE = "(resolution_status IS NULL OR resolution_status IN ('open', 'acknowledged'))"


def _recent(days: int) -> str:
    return f"resolution_updated_at >= {AS_OF} - INTERVAL {days} DAY"


@query("c7_resolution_filter", f"""SELECT test_result_id, 'active' AS choice FROM one_state WHERE {_ACTIVE}
  UNION ALL SELECT test_result_id, 'resolved' FROM one_state WHERE resolution_status = 'resolved' AND {_recent(20)}
  UNION ALL SELECT test_result_id, 'muted' FROM one_state WHERE resolution_status = 'muted' AND {_recent(7)}
  UNION ALL SELECT test_result_id, 'all' FROM one_state WHERE {_ACTIVE} OR {_recent(7)}
  UNION ALL SELECT test_result_id, 'none' FROM one_state""")
def resolution_filter(g: Given):
    state = incidents.with_resolution(g.tables, incidents.incident_keys(g.tables)).select(
        "test_result_id", "resolution_status", "resolution_updated_at"
    )
    choices = (("active", None), ("resolved", 20), ("muted", 7), ("all", 7), (None, None))
    picked = F.filter(
        F.array(*[
            F.when(incidents.resolution_condition(status, days, g.as_of), F.lit(status or "none"))
            for status, days in choices
        ]),
        lambda choice: choice.isNotNull(),
    )
    return state.select("test_result_id", F.explode(picked).alias("choice"))


@query("c8_failing_tests", f"SELECT test_result_id, test_name, {sql.canonical('dataset_urn')} AS dataset_urn, status FROM tests WHERE status IN ('failed', 'error')")
def failing(g: Given):
    return incidents.failing_tests(g.tables).select("test_result_id", "test_name", "dataset_urn", F.col("test_status").alias("status"))


def _list_sql(where: str) -> str:
    """The list: per incident its newest producer among the rows that pass, then one aggregation per retry group."""
    return f"""SELECT unnest(best.row), coalesce(best.state.status, 'open') AS resolution_status, best.state.resolved_by AS resolved_by,
    best.state.resolution_reason AS resolution_reason, best.state.mute_expires_at AS mute_expires_at,
    best.state.updated_at AS resolution_updated_at, total_attempts, total_attempts AS current_attempt, all_failed,
    total_attempts > 1 AS has_retry_context
  FROM (SELECT arg_max(found, (found.row.test_executed_at, found.row.test_result_id)) AS best, count(*) AS total_attempts,
      bool_and(found.row.test_status IN ('failed', 'error')) AS all_failed
    FROM (SELECT arg_min({{'row': v, 'state': ir}}, (-epoch_us(v.job_started_at), v.job_run_id, v.produced_urn)) AS found
      FROM icv_all v LEFT JOIN resolutions ir ON v.test_result_id = ir.test_result_id WHERE {where} GROUP BY v.test_result_id) x
    GROUP BY found.row.test_name, found.row.dataset_urn,
      coalesce(nullif(CAST(found.row.test_root_parent_run_id AS VARCHAR), ''), CAST(found.row.test_result_id AS VARCHAR))) y"""


_LIST_COLUMNS = (
    "test_result_id, test_name, test_type, test_status, test_message, test_executed_at, test_duration_ms, test_producer_name, "
    "dataset_urn, dataset_name, dataset_namespace, job_run_id, job_name, job_namespace, job_status, job_event_type, job_started_at, "
    "job_completed_at, job_producer_name, test_root_parent_run_id, resolution_status, resolved_by, resolution_reason, "
    "mute_expires_at, resolution_updated_at, total_attempts, current_attempt, all_failed, has_retry_context"
)


def _cut(frame, columns: str):
    return frame.select(*[c.strip() for c in columns.split(",")])


@query("f1_one_producer", "SELECT test_result_id, dataset_urn, job_run_id, job_started_at, produced_urn FROM one")
def one_producer(g: Given):
    return incidents.incident_heads(g.tables).select("test_result_id", "dataset_urn", "job_run_id", "job_started_at", "produced_urn")


@query("f2_latest_attempt", f"SELECT {_LIST_COLUMNS} FROM ({_list_sql('true')}) q")
def latest_attempt(g: Given):
    return _cut(incidents.list_incidents(g.tables, g.as_of), _LIST_COLUMNS)


_SLIM = "test_result_id, test_name, dataset_urn, total_attempts, current_attempt, all_failed, has_retry_context"


@query("f3_active_list", f"SELECT {_SLIM} FROM ({_list_sql(_ACTIVE.replace('resolution_status', 'ir.status'))}) q")
def active_list(g: Given):
    return _cut(incidents.list_incidents(g.tables, g.as_of, incidents.IncidentFilter()), _SLIM)


_FULL_FILTER = f"{_TRUE_FILTER} AND (ir.status IS NULL OR ir.status IN ('open', 'acknowledged') OR ir.updated_at >= {AS_OF} - INTERVAL 14 DAY)"


@query("l1_filtered_list", f"SELECT {_SLIM}, job_run_id FROM ({_list_sql(_FULL_FILTER)}) q")
def filtered_list(g: Given):
    wanted = incidents.IncidentFilter(
        job_status="FAIL", job_producer_name="airflow", status="all", window_days=14,
        executed_after=dt.datetime(2024, 1, 3), executed_before=dt.datetime(2024, 1, 28),
    )
    return _cut(incidents.list_incidents(g.tables, g.as_of, wanted), _SLIM + ", job_run_id")


_ATTEMPTS = f"""SELECT test_result_id, test_name, dataset_urn, test_executed_at,
  row_number() OVER ({GROUP} ORDER BY test_executed_at, test_result_id) AS attempt, count(*) OVER ({GROUP}) AS total_attempts FROM one"""


@query("f4_attempt_numbers", _ATTEMPTS)
def attempt_numbers(g: Given):
    return incidents.retry_attempts(g.tables, g.scratch).select(
        "test_result_id", "test_name", "dataset_urn", "test_executed_at", "attempt", "total_attempts"
    )


@query("d9_retry_siblings", f"SELECT test_result_id, test_name, dataset_urn, attempt, total_attempts - 1 AS siblings FROM ({_ATTEMPTS}) a "
       "WHERE test_result_id IN (SELECT test_result_id FROM one WHERE test_root_parent_run_id IS NOT NULL)")
def retry_siblings(g: Given):
    attempts = incidents.retry_attempts(g.tables, g.scratch).filter("test_root_parent_run_id IS NOT NULL")
    return attempts.select("test_result_id", "test_name", "dataset_urn", "attempt", (F.col("total_attempts") - 1).alias("siblings"))


@query("e7_all_failed", f"SELECT {_SLIM.replace('test_result_id, ', '')} FROM ({_list_sql('true')}) q")
def all_failed(g: Given):
    return _cut(incidents.list_incidents(g.tables, g.as_of), _SLIM.replace("test_result_id, ", ""))


@query("f6_other_attempts", """SELECT *, count(*) OVER (PARTITION BY test_name, dataset_urn, retry_key) AS total_attempts FROM (
  SELECT test_name, dataset_urn, coalesce(nullif(CAST(test_root_parent_run_id AS VARCHAR), ''), CAST(test_result_id AS VARCHAR)) AS retry_key,
  test_result_id, test_status, test_executed_at, job_run_id, coalesce(resolution_status, 'open') AS resolution_status,
  row_number() OVER (PARTITION BY test_name, dataset_urn, retry_key ORDER BY test_executed_at, test_result_id) AS attempt FROM one_state) q""")
def other_attempts(g: Given):
    """All attempts of all retry groups; the siblings of an incident are the other rows of its group."""
    return incidents.attempt_rows(g.tables, g.scratch)


@query("g1_list_page", f"SELECT {_SLIM}, test_executed_at, (SELECT count(*) FROM ({_list_sql('true')}) t) AS total_count FROM ({_list_sql('true')}) q "
       "ORDER BY test_executed_at DESC, test_result_id DESC LIMIT 20 OFFSET 20")
def list_page(g: Given):
    params = validation.check_page(limit=20, offset=20)
    listed = g.scratch.cut(_cut(incidents.list_incidents(g.tables, g.as_of), _SLIM + ", test_executed_at"))
    return incidents.page(listed, params["limit"], params["offset"])


@query("f5_total_count", f"SELECT count(*) AS total_count FROM ({_list_sql('true')}) q")
def total_count(g: Given):
    return incidents.list_incidents(g.tables, g.as_of).agg(F.count(F.lit(1)).alias("total_count"))


@query("f7_produced_urns", "SELECT dataset_urn, producer FROM made_urns")
def produced_urns(g: Given):
    return health.produced_urns(g.tables)


_IMPACT_COLUMNS = "run_id, job_name, job_namespace, job_status, dataset_urn, dataset_name, dataset_namespace, depth, dataset_path_length"


@query("i1_impact", f"SELECT {_IMPACT_COLUMNS} FROM impact")
def impact(g: Given):
    return graph.impact(g.tables, g.scratch)


@query("f8_shortest_path", "SELECT run_id, dataset_urn, depth FROM impact WHERE depth > 0")
def shortest_path(g: Given):
    return graph.impact(g.tables, g.scratch).filter("depth > 0").select("run_id", "dataset_urn", "depth")


@query("e1_downstream_counts", "SELECT run_id, downstream_count FROM counts")
def downstream_counts(g: Given):
    return graph.downstream_counts(graph.impact(g.tables, g.scratch))


@query("d12_counts_by_id", "SELECT run_id, downstream_count FROM counts WHERE run_id IN (SELECT job_run_id FROM one)")
def counts_by_id(g: Given):
    """Counts for a list of runs: only those are expanded."""
    runs = incidents.incident_heads(g.tables).select(F.col("job_run_id").alias("run_id"))
    return graph.downstream_counts(graph.impact(g.tables, g.scratch, g.scratch.cut(runs.distinct())))


@query("i2_downstream_trees", "SELECT run_id, dataset_urn, dataset_name, depth, parent_urn, producer FROM down_tree")
def downstream_trees(g: Given):
    return graph.downstream_trees(g.tables, g.scratch)


def _starts(g: Given):
    heads = incidents.incident_heads(g.tables)
    return g.scratch.cut(heads.select("dataset_urn", F.col("job_run_id").alias("run_id")).distinct())


@query("i3_upstream_trees", "SELECT start_urn, run_id, dataset_urn, dataset_name, depth, child_urn, producer FROM up_tree")
def upstream_trees(g: Given):
    return graph.upstream_trees(g.tables, g.scratch, _starts(g))


@query("d10_upstream_producers", "SELECT DISTINCT dataset_urn, producer FROM up_tree")
def upstream_producers(g: Given):
    return graph.upstream_trees(g.tables, g.scratch, _starts(g)).select("dataset_urn", "producer").distinct()


_CHAIN = "run_id, ancestor_run_id, depth, job_name, job_namespace, producer_name, status"


@query("i4_chains", f"SELECT {_CHAIN} FROM chain")
def chains(g: Given):
    return _cut(graph.orchestration_chains(g.tables, g.scratch), _CHAIN)


@query("i5_chain_levels", """SELECT c.run_id, m.n - c.depth AS position, c.ancestor_run_id AS level_run_id, c.job_name, c.job_namespace, c.producer_name, c.status, false AS is_current
  FROM chain c JOIN (SELECT run_id, max(depth) AS n FROM chain GROUP BY run_id) m ON c.run_id = m.run_id
  UNION ALL SELECT r.run_id, m.n, r.run_id, r.job_name, r.job_namespace, r.producer_name, r.current_state, true FROM runs r
  JOIN (SELECT run_id, max(depth) AS n FROM chain GROUP BY run_id) m ON r.run_id = m.run_id""")
def chain_levels(g: Given):
    found = g.scratch.cut(graph.orchestration_chains(g.tables, g.scratch))
    return graph.chain_levels(g.tables, found)


@query("i6_batch_trees", "SELECT run_id, dataset_urn, dataset_name, depth, parent_urn, producer FROM down_tree WHERE run_id IN (SELECT job_run_id FROM one)")
def batch_trees(g: Given):
    """The trees of the runs behind incidents, walked together."""
    return graph.downstream_trees(g.tables, g.scratch, _starts(g))


@query("f9_shortest_in_tree", "SELECT run_id, dataset_urn, min(depth) AS depth FROM down_tree GROUP BY run_id, dataset_urn")
def shortest_in_tree(g: Given):
    return graph.shortest(graph.downstream_trees(g.tables, g.scratch), ["run_id"])


@query("e10_impact_summary", """SELECT coalesce(b.run_id, a.run_id) AS run_id, coalesce(downstream_count, 0) AS downstream_count,
  coalesce(direct_downstream, 0) AS direct_downstream, coalesce(indirect_downstream, 0) AS indirect_downstream,
  coalesce(upstream_count, 0) AS upstream_count FROM
  (SELECT run_id, count(*) AS downstream_count, count(*) FILTER (WHERE depth = 1) AS direct_downstream,
     count(*) FILTER (WHERE depth > 1) AS indirect_downstream FROM (SELECT run_id, dataset_urn, min(depth) AS depth FROM down_tree
     WHERE run_id IN (SELECT run_id FROM up_starts) GROUP BY run_id, dataset_urn) x GROUP BY run_id) b
  FULL JOIN (SELECT run_id, count(DISTINCT dataset_urn) AS upstream_count FROM up_tree GROUP BY run_id) a ON a.run_id = b.run_id""")
def impact_summary(g: Given):
    starts = _starts(g)
    return graph.impact_summary(
        graph.downstream_trees(g.tables, g.scratch, starts), graph.upstream_trees(g.tables, g.scratch, starts)
    )


@query("g4_ordered_trees", "SELECT run_id, dataset_urn, depth, parent_urn FROM down_tree ORDER BY run_id, depth, dataset_urn")
def ordered_trees(g: Given):
    tree = graph.downstream_trees(g.tables, g.scratch).select("run_id", "dataset_urn", "depth", "parent_urn")
    return tree.orderBy("run_id", "depth", "dataset_urn")


@query("g5_events_by_time", "SELECT arrival, run_id, event_time FROM ev WHERE event_time IS NOT NULL ORDER BY event_time, arrival")
def events_by_time(g: Given):
    # Written, as sorting draws its bounds in a pass of its own.
    slim = g.scratch.cut(g.heads.select("arrival", "run_id", "event_time").filter("event_time IS NOT NULL"))
    return slim.orderBy("event_time", "arrival")


@query("g6_any_producer", "SELECT dataset_urn, min(job_run_id) AS job_run_id FROM one GROUP BY dataset_urn")
def any_producer(g: Given):
    return incidents.incident_heads(g.tables).groupBy("dataset_urn").agg(F.min("job_run_id").alias("job_run_id"))


@query("h1_all_urns", "SELECT raw_urn FROM rd")
def all_urns(g: Given):
    return incidents.all_urns(g.tables)


@query("h2_union_all", """SELECT edge_type, dataset_urn, count(*) AS n FROM (SELECT edge_type, dataset_urn FROM edges
  UNION ALL SELECT 'test', dataset_urn FROM tests) u GROUP BY edge_type, dataset_urn""")
def union_everything(g: Given):
    parts = [g["edges"].select("edge_type", "dataset_urn"), g["tests"].select(F.lit("test").alias("edge_type"), "dataset_urn")]
    return graph.union_all(parts).groupBy("edge_type", "dataset_urn").agg(F.count(F.lit(1)).alias("n"))


@query("h3_stale_names", """SELECT concat('old/', dataset_urn) AS raw_urn, dataset_urn AS canonical_urn FROM datasets""")
def stale_names(g: Given):
    stored = incidents.resolved_datasets(g.tables).unionByName(
        g["datasets"].select(F.concat(F.lit("old/"), "dataset_urn").alias("raw_urn"), F.col("dataset_urn").alias("canonical_urn"))
    )
    return incidents.stale_resolved(g.tables, stored)


@query("h4_distinct_rows", "SELECT DISTINCT parent_urn, dataset_urn, producer FROM down_tree")
def distinct_rows(g: Given):
    return graph.downstream_trees(g.tables, g.scratch).select("parent_urn", "dataset_urn", "producer").distinct()


@query("e2_tested_datasets", "SELECT * FROM tested")
def tested_datasets(g: Given):
    return health.tested_datasets(g.tables)


@query("d5_unproduced", "SELECT dataset_urn, test_count, last_seen, producer FROM lonely")
def unproduced(g: Given):
    return health.unproduced(g.tables)


@query("g2_ordered_orphans", "SELECT dataset_urn, test_count FROM orphans ORDER BY test_count DESC, dataset_urn")
def ordered_orphans(g: Given):
    return health.ordered_orphans(health.orphans(g.tables)).select("dataset_urn", "test_count")


@query("d6_produced_tested", f"""SELECT DISTINCT {sql.canonical('dataset_urn')} AS canonical_urn, 'any' AS kind FROM tests
  WHERE {sql.canonical('dataset_urn')} IN (SELECT canonical_urn FROM produced)
  UNION ALL SELECT DISTINCT {sql.canonical('dataset_urn')}, 'failed' FROM tests WHERE status IN ('failed', 'error')
  AND {sql.canonical('dataset_urn')} IN (SELECT canonical_urn FROM produced)""")
def produced_tested(g: Given):
    tested = g["tests"].select(g.tables.canonical("dataset_urn").alias("canonical_urn"), "status")
    flags = tested.groupBy("canonical_urn").agg(F.bool_or(F.col("status").isin(*ef.INCIDENT_STATUSES)).alias("failed"))
    found = flags.join(health.produced_canonical(g.tables), "canonical_urn", "left_semi")
    kinds = F.when(F.col("failed"), F.array(F.lit("any"), F.lit("failed"))).otherwise(F.array(F.lit("any")))
    return found.select("canonical_urn", F.explode(kinds).alias("kind"))


@query("d7_likely_match", "SELECT dataset_urn, match_urn, match_confidence, match_reason, match_producer FROM orphans")
def likely_match(g: Given):
    return health.orphans(g.tables).select("dataset_urn", "match_urn", "match_confidence", "match_reason", "match_producer")


# One row per dataset with a flag for each way it occurs.
_STATS = f"""SELECT count_if(failing) AS failed_tested, count_if(failing AND made) AS correlated_failed, count_if(tested) AS tested,
  count_if(made) AS produced, count_if(tested AND made) AS correlated FROM (
  SELECT bool_or(kind = 'made') AS made, bool_or(kind <> 'made') AS tested, bool_or(kind IN ('failed', 'error')) AS failing FROM (
    SELECT {sql.canonical('dataset_urn')} AS urn, status AS kind FROM tests UNION ALL SELECT canonical_urn, 'made' FROM produced) u GROUP BY urn) f"""


@query("e3_health_stats", _STATS)
def health_stats(g: Given):
    return health.health_stats(g.tables)


@query("d11_counts_row", f"SELECT 'all' AS scope, s.* FROM ({_STATS}) s")
def counts_row(g: Given):
    return health.health_stats(g.tables).select(F.lit("all").alias("scope"), "*")


_RATE = "CASE WHEN failed_tested = 0 THEN 1.0::DOUBLE ELSE correlated_failed::DOUBLE / failed_tested END"


@query("e4_correlation_rate", f"SELECT {_RATE} AS correlation_rate FROM ({_STATS}) s")
def correlation_rate(g: Given):
    return health.correlation_rate(health.health_stats(g.tables)).select("correlation_rate")


def _counts_sql(days: int) -> str:
    """Each retry group is one row, with the state of its newest attempt; the states are then added up."""
    recent = f"newest.moved >= {AS_OF} - INTERVAL {days} DAY"
    shown = {"active": "coalesce(newest.state, 'open') IN ('open', 'acknowledged')",
             **{state: f"newest.state = '{state}' AND {recent}" for state in ("resolved", "muted")}}
    sums = ", ".join(f"coalesce(sum(CASE WHEN {rule} THEN 1 END), 0)::BIGINT AS {name}" for name, rule in shown.items())
    return f"""SELECT {sums} FROM (SELECT arg_max({{'state': resolution_status, 'moved': resolution_updated_at}}, (test_executed_at, test_result_id)) AS newest
  FROM one_state GROUP BY test_name, dataset_urn, {sql.RETRY}) g"""


@query("e5_incident_counts", _counts_sql(30))
def incident_counts(g: Given):
    return incidents.count_incidents(g.tables, g.as_of)


@query("l3_incident_counts", _counts_sql(7))
def incident_counts_week(g: Given):
    return incidents.count_incidents(g.tables, g.as_of, window_days=7)


_NAMED = r"""SELECT dataset_urn, match_urn, regexp_extract(dataset_urn, '^(.*://[^/]*|[^/]*)/(.*)$', 1) AS ons,
  regexp_extract(dataset_urn, '^(.*://[^/]*|[^/]*)/(.*)$', 2) AS onm, regexp_extract(match_urn, '^(.*://[^/]*|[^/]*)/(.*)$', 1) AS cns,
  regexp_extract(match_urn, '^(.*://[^/]*|[^/]*)/(.*)$', 2) AS cnm FROM {0} WHERE match_urn IS NOT NULL"""
_RULES = """SELECT dataset_urn, CASE WHEN ons <> cns THEN 'namespace' WHEN strpos(onm, '.') = 0 THEN 'exact' ELSE 'name' END AS category,
  CASE WHEN ons <> cns THEN concat(ons, '/{{name}}') WHEN strpos(onm, '.') = 0 THEN dataset_urn
    ELSE concat(ons, '/', regexp_replace(onm, '[^.]*$', ''), '{{table}}') END AS pattern,
  CASE WHEN ons <> cns THEN concat(cns, '/{{name}}') WHEN strpos(onm, '.') = 0 THEN match_urn
    ELSE concat(cns, '/', regexp_replace(cnm, '[^.]*$', ''), '{{table}}') END AS canonical FROM ({0}) n
  WHERE (ons <> cns AND onm = cnm) OR (ons = cns AND onm <> cnm AND (suffix(onm, concat('.', cnm)) OR suffix(cnm, concat('.', onm))))"""


@query("e6_patterns", "SELECT category, pattern, canonical, count(*) AS resolves_count FROM (" + _RULES.format(_NAMED.format("orphans")) +
       ") r GROUP BY category, pattern, canonical")
def patterns(g: Given):
    return health.suggested_patterns(health.orphans(g.tables))


# Every produced name next to a shorter or renamed form of itself, for all three kinds of rule.
_VARIANTS = """SELECT CASE last_producing_run_id % 4 WHEN 0 THEN replace(dataset_urn, 'analytics.', '') WHEN 1 THEN concat('other/', name)
  WHEN 2 THEN regexp_replace(dataset_urn, 'analytics\\.s[0-9]+\\.', '') ELSE replace(dataset_urn, 'analytics.', 'db.analytics.') END AS dataset_urn,
  dataset_urn AS match_urn FROM datasets"""


@query("e6_pattern_orphans", _RULES.format(_NAMED.format(f"({_VARIANTS}) v")))
def pattern_orphans(g: Given):
    urn, part = F.col("dataset_urn"), F.col("last_producing_run_id") % 4
    other = (
        F.when(part == 0, F.replace(urn, F.lit("analytics."), F.lit("")))
        .when(part == 1, F.concat(F.lit("other/"), "name"))
        .when(part == 2, F.regexp_replace(urn, r"analytics\.s[0-9]+\.", ""))
        .otherwise(F.replace(urn, F.lit("analytics."), F.lit("db.analytics.")))
    )
    return health.suggested_rules(g["datasets"].select(other.alias("dataset_urn"), urn.alias("match_urn")))


@query("g3_ordered_patterns", "SELECT pattern, canonical, count(*) AS resolves_count FROM (" + _RULES.format(_NAMED.format("orphans")) +
       ") r GROUP BY pattern, canonical ORDER BY resolves_count DESC, pattern")
def ordered_patterns(g: Given):
    return health.ordered_patterns(health.suggested_patterns(health.orphans(g.tables))).drop("category")


_ENRICHED = f"""SELECT q.*, coalesce(c.downstream_count, 0) AS downstream_count, q.dataset_urn IN (SELECT dataset_urn FROM lonely) AS has_correlation_issue
  FROM ({_list_sql('true')}) q LEFT JOIN counts c ON q.job_run_id = c.run_id"""


@query("d13_enriched_list", f"SELECT test_result_id, job_run_id, downstream_count, has_correlation_issue FROM ({_ENRICHED}) e")
def enriched_list(g: Given):
    return detail.incident_list(g.tables, g.scratch, g.as_of).select(
        "test_result_id", "job_run_id", "downstream_count", "has_correlation_issue"
    )


@query("l1_incident_list", f"SELECT {_LIST_COLUMNS}, downstream_count, has_correlation_issue FROM ({_ENRICHED}) e")
def incident_list(g: Given):
    return _cut(detail.incident_list(g.tables, g.scratch, g.as_of), _LIST_COLUMNS + ", downstream_count, has_correlation_issue")


@query("e8_list_totals", f"SELECT (SELECT count(*) FROM ({_list_sql('true')}) q) AS total, (SELECT count(*) FROM lonely) AS orphan_count")
def list_totals(g: Given):
    return detail.list_totals(incidents.list_incidents(g.tables, g.as_of), health.unproduced(g.tables))


@query("c9_list_views", f"""SELECT 'all' AS choice, test_result_id FROM ({_ENRICHED}) a UNION ALL
  SELECT 'failed', test_result_id FROM ({_ENRICHED}) b WHERE test_status = 'failed' UNION ALL
  SELECT 'passed', test_result_id FROM ({_ENRICHED}) c WHERE test_status = 'passed' UNION ALL
  SELECT 'correlation_issues', test_result_id FROM ({_ENRICHED}) d WHERE has_correlation_issue""")
def list_views(g: Given):
    listed = g.scratch.cut(detail.incident_list(g.tables, g.scratch, g.as_of))
    views = [
        incidents.filter_view(listed, choice).select(F.lit(choice).alias("choice"), "test_result_id")
        for choice in ("all", "failed", "passed", "correlation_issues")
    ]
    return graph.union_all(views)


@query("c10_page_rules", f"SELECT test_result_id FROM ({_list_sql(_ACTIVE.replace('resolution_status', 'ir.status'))}) q "
       "ORDER BY test_executed_at DESC, test_result_id DESC LIMIT 20")
def page_rules(g: Given):
    """The default page: active incidents, 20 rows, first page."""
    rules = validation.check_page()
    wanted = incidents.IncidentFilter(status=rules["status"], window_days=rules["window_days"])
    listed = incidents.list_incidents(g.tables, g.as_of, wanted).select("test_result_id", "test_executed_at")
    return incidents.page(listed, rules["limit"], rules["offset"]).select("test_result_id")


_ENDED_ABOVE = f"job_status IN ('RUNNING','START','OTHER','') AND parent_job_status IN {sql.TERMINAL}"
_HEADS = f"""(SELECT o.*, CASE WHEN {_ENDED_ABOVE} THEN parent_job_status ELSE job_status END AS effective_job_status,
  CASE WHEN {_ENDED_ABOVE} THEN parent_job_completed_at ELSE job_completed_at END AS effective_completed_at,
  CASE WHEN o.dataset_urn IN (SELECT dataset_urn FROM lonely) THEN 'orphan' ELSE 'correlated' END AS correlation_status, a.total_attempts
  FROM (SELECT * REPLACE (coalesce(resolution_status, 'open') AS resolution_status) FROM one_state) o
  JOIN ({_ATTEMPTS}) a ON o.test_result_id = a.test_result_id)"""
_TIMES = ("test_executed_at", "job_started_at", "job_completed_at", "parent_job_completed_at", "root_parent_job_completed_at",
          "effective_completed_at", "mute_expires_at")
_DETAIL = {
    "head": (_HEADS, [f"@{c}" if c in _TIMES else c for c in (
        *incidents.VIEW_COLUMNS, "effective_job_status", "effective_completed_at", "correlation_status", "resolution_status", "resolved_by",
        "resolution_reason", "mute_expires_at", "total_attempts")]),
    "downstream": ("(SELECT * FROM down_tree WHERE run_id IN (SELECT job_run_id FROM one))",
                   ["run_id", "dataset_urn", "dataset_name", "depth", "parent_urn", "producer"]),
    "upstream": ("up_tree", ["start_urn", "run_id", "dataset_urn", "dataset_name", "depth", "child_urn", "producer"]),
    "chain": ("(SELECT * FROM chain WHERE run_id IN (SELECT job_run_id FROM one))",
              ["run_id", "ancestor_run_id", "depth", "job_name", "job_namespace", "producer_name", "status"]),
    "attempt": (f"""(SELECT *, row_number() OVER ({sql.GROUP} ORDER BY test_executed_at, test_result_id) AS attempt, {sql.RETRY} AS retry_key,
      count(*) OVER ({sql.GROUP}) AS total_attempts, coalesce(resolution_status, 'open') AS state FROM one_state)""",
                ["test_name", "dataset_urn", "retry_key", "test_result_id", "attempt", "total_attempts", "test_status", "@test_executed_at",
                 "job_run_id", "state"]),
}


@query("l2_incident_detail", " UNION ALL ".join(line_sql(kind, f"{table} AS {kind}_rows", *columns) for kind, (table, columns) in _DETAIL.items()))
def incident_detail(g: Given):
    """Whole rows: heads, both trees, chains and attempts of all incidents."""
    found = detail.details(g.tables, g.scratch)
    tables = {"head": found.heads, "downstream": found.downstream, "upstream": found.upstream, "chain": found.chains,
              "attempt": found.attempts.withColumnRenamed("resolution_status", "state")}
    return union([lines(tables[kind], kind, *columns) for kind, (_, columns) in _DETAIL.items()])


@query("l4_health", f"""SELECT {_RATE} AS correlation_rate, tested AS total_datasets, produced AS produced_datasets, correlated AS correlated_datasets,
  (SELECT count(*) FROM orphans) AS orphan_datasets, (SELECT count(*) FROM (SELECT DISTINCT pattern, canonical FROM ({_RULES.format(_NAMED.format("orphans"))}) r) p) AS suggested_patterns
  FROM ({_STATS}) s""")
def health_report(g: Given):
    return health.health_report(g.tables)


_ORPHAN_COLUMNS = "dataset_urn, test_count, last_seen, producer, match_urn, match_confidence, match_reason, match_producer"


@query("l5_orphans", f"SELECT {_ORPHAN_COLUMNS} FROM orphans")
def orphans(g: Given):
    return health.orphans(g.tables)


@query("l6_orphan_split", "SELECT dataset_urn, CASE WHEN match_urn IS NULL THEN 'unmatched' ELSE 'matched' END AS part FROM orphans")
def orphan_split(g: Given):
    found = health.orphans(g.tables)
    return health.matched_orphans(found).select("dataset_urn", F.lit("matched").alias("part")).unionByName(
        health.unmatched_orphans(found).select("dataset_urn", F.lit("unmatched").alias("part"))
    )
