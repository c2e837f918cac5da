import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.functions.aliases import AliasResolver
from causeway.plans import graph, health, incidents, quality
from causeway.plans.incidents import Tables

T0 = dt.datetime(2024, 1, 1)
RUN = "run_id string, job_name string, job_namespace string, current_state string, event_type string, started_at timestamp, " \
      "completed_at timestamp, parent_run_id string, root_parent_run_id string, producer_name string"
TEST = "test_result_id long, test_name string, test_type string, dataset_urn string, run_id string, status string, message string, " \
       "executed_at timestamp, duration_ms int, producer_name string"
RESOLUTION = "test_result_id long, status string, resolved_by string, resolution_reason string, mute_expires_at timestamp, updated_at timestamp"


def tables(spark, edges, tests=(), resolutions=(), parents=(), roots=(), extra_datasets=(), rules=()):
    parents, roots = dict(parents), dict(roots)
    names = sorted({e[0] for e in edges} | set(parents) | set(roots) | {t[4] for t in tests})
    runs = [
        (r, f"job {r}", "ns", "COMPLETE", "COMPLETE", T0 + dt.timedelta(hours=i), None, parents.get(r), roots.get(r), f"p{i % 2}")
        for i, r in enumerate(names)
    ]
    urns = sorted({e[1] for e in edges} | {t[3] for t in tests} | set(extra_datasets))
    return Tables(
        runs=spark.createDataFrame(runs, RUN),
        datasets=spark.createDataFrame([(u, u, "n") for u in urns], "dataset_urn string, name string, namespace string"),
        edges=spark.createDataFrame(list(edges), "run_id string, dataset_urn string, edge_type string"),
        tests=spark.createDataFrame(list(tests), TEST),
        resolutions=spark.createDataFrame(list(resolutions), RESOLUTION),
        aliases=AliasResolver(rules),
    )


def result(i, name, urn, run, status, hour):
    return (i, name, "dq", urn, run, status, "", T0 + dt.timedelta(hours=hour), 1, "ge")


def random_edges(seed, n_runs, n_urns):
    rng = random.Random(seed)
    return sorted({
        (f"r{r}", f"n/d{rng.randrange(n_urns)}", kind)
        for r in range(n_runs) for kind in ("input", "output") for _ in range(rng.randrange(3))
    })


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impact_with_cycles(spark, scratch, seed):
    edges = random_edges(seed, 14, 9)
    t = tables(spark, edges)
    got = {(r.run_id, r.dataset_urn): r.depth for r in graph.impact(t, scratch, max_depth=4).collect()}
    consumers, made = defaultdict(set), defaultdict(set)
    for run, urn, kind in edges:
        (consumers[urn].add(run) if kind == "input" else made[run].add(urn))
    want = {}

    def paths(run, urn, depth, seen):
        want[run, urn] = min(depth, want.get((run, urn), 99))
        if depth < 4:
            for nxt in {o for c in consumers[urn] for o in made[c]} - set(seen):
                paths(run, nxt, depth + 1, (*seen, nxt))

    for run in list(made):
        for urn in made[run]:
            paths(run, urn, 0, (urn,))
    assert got == want


def test_a_wide_run_is_walked_through(spark, scratch):
    wide = [("w", f"n/in{i}", "input") for i in range(2000)] + [("w", f"n/out{i}", "output") for i in range(2000)]
    t = tables(spark, [*wide, ("p", "n/in7", "output"), ("p", "n/in8", "output")])
    depths = graph.impact(t, scratch).groupBy("run_id", "depth").count().collect()
    assert {(r.run_id, r.depth): r["count"] for r in depths} == {("w", 0): 2000, ("p", 0): 2, ("p", 1): 2000}
    asked = spark.createDataFrame([("p",)], "run_id string")
    tree = graph.downstream_trees(t, scratch, asked).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in tree} == {1: 4000}


@pytest.mark.parametrize("seed", [4, 5])
def test_trees_repeat_on_every_level(spark, scratch, seed):
    edges = random_edges(seed, 10, 7)
    t = tables(spark, edges)
    makers = {r.run_id: r.producer_name for r in t.runs.collect()}
    inputs, outputs = defaultdict(set), defaultdict(set)
    for run, urn, kind in edges:
        (inputs if kind == "input" else outputs)[run].add(urn)
    for run in makers:  # every run has both entries
        inputs[run], outputs[run]
    got = {tuple(r) for r in graph.downstream_trees(t, scratch, max_depth=3).select("run_id", "dataset_urn", "depth", "parent_urn", "producer").collect()}
    want = set()
    for run in outputs:
        level = set(outputs[run])
        for depth in range(1, 4):
            rows = {(o, d, makers[c]) for d in level for c in inputs if d in inputs[c] for o in outputs[c] if o != d}
            want |= {(run, o, depth, d, p) for o, d, p in rows}
            level = {o for o, _, _ in rows}
    assert got == want
    starts = spark.createDataFrame([("n/x", r) for r in makers], "dataset_urn string, run_id string")
    up = {tuple(r) for r in graph.upstream_trees(t, scratch, starts, max_depth=3).select("run_id", "dataset_urn", "depth", "child_urn", "producer").collect()}
    want_up = set()
    for run in makers:
        rows = {(i, "n/x") for i in inputs[run]}
        for depth in range(1, 4):
            for urn, child in rows:
                known = {makers[m] for m in outputs if urn in outputs[m]} or {""}
                want_up |= {(run, urn, depth, child, p) for p in known}
            rows = {(i, u) for u, _ in rows for m in outputs if u in outputs[m] for i in inputs[m] if i != u}
    assert up == want_up


def test_chains(spark, scratch):
    t = tables(spark, [], parents={"c": "b", "b": "a", "x": "gone", "l1": "l2", "l2": "l1"}, roots={"a": None})
    chains = graph.orchestration_chains(t, scratch, max_depth=4)
    rows = {(r.run_id, r.depth): r.ancestor_run_id for r in chains.collect()}
    assert rows[("c", 1)] == "b" and rows[("c", 2)] == "a" and ("c", 3) not in rows and ("x", 1) not in rows
    assert [rows[("l1", d)] for d in range(1, 5)] == ["l2", "l1", "l2", "l1"]
    levels = graph.chain_levels(t, chains).collect()
    shown = {run: [r.level_run_id for r in sorted(levels, key=lambda r: r.position) if r.run_id == run] for run in "cxa"}
    assert shown == {"c": ["a", "b", "c"], "x": ["gone", "x"], "a": []}


def test_retries_and_filters(spark, scratch):
    edges = [("w", "n/d", "output"), ("w2", "n/d", "output")]
    tests = [result(600, "t", "n/d", "a1", "failed", 1), result(601, "t", "n/d", "a2", "error", 2), result(602, "t", "n/d", "a3", "passed", 3),
             result(700, "u", "n/d", "a1", "failed", 1), result(701, "v", "n/d", "none", "failed", 5)]
    closed = [(601, "resolved", "x", "manual", None, T0)]
    t = tables(spark, edges, tests, closed, roots={"a1": "root", "a2": "root", "a3": "root"})
    as_of = F.lit(T0 + dt.timedelta(days=3))
    listed = {r.test_result_id: r for r in incidents.list_incidents(t, as_of).collect()}
    assert set(listed) == {601, 700, 701}
    assert (listed[601].total_attempts, listed[601].current_attempt, listed[601].all_failed, listed[601].job_run_id) == (2, 2, True, "w2")
    active = {r.test_result_id: r.total_attempts for r in incidents.list_incidents(t, as_of, incidents.IncidentFilter()).collect()}
    assert active == {600: 1, 700: 1, 701: 1}
    counts = incidents.count_incidents(t, as_of).first()
    assert (counts.active, counts.resolved, counts.muted) == (2, 1, 0)
    by_run = incidents.list_incidents(t, as_of, incidents.IncidentFilter(run_id="w", status=None)).collect()
    assert {r.job_run_id for r in by_run} == {"w"} and len(by_run) == 3
    asked = spark.createDataFrame([(601,)], "test_result_id long")
    others = incidents.other_attempts(t, asked, scratch).collect()
    assert [(r.test_result_id, r.attempt, r.resolution_status) for r in others] == [(600, 1, "open")]
    assert incidents.page(incidents.list_incidents(t, as_of), 20, 100).collect() == []
    assert incidents.page(incidents.list_incidents(t, as_of), 1, 0).first().total_count == 3


def test_aliases_connect_tools_and_health(spark):
    edges = [("w", "postgresql://h/db.marts.orders", "output"), ("w", "postgresql://h/raw", "output")]
    tests = [result(1, "t", "postgresql://h/marts.orders", "a", "failed", 1), result(2, "t", "other/raw", "a", "failed", 1),
             result(3, "t", "lost/thing", "a", "passed", 1)]
    t = tables(spark, edges, tests)
    assert incidents.incident_view(t).count() == 0
    stats = health.correlation_rate(health.health_stats(t)).first()
    assert (stats.failed_tested, stats.correlated_failed, stats.tested, stats.correlation_rate) == (2, 0, 3, 0.0)
    found = health.orphans(t)
    assert {r.dataset_urn: r.match_urn for r in found.collect()} == {
        "postgresql://h/marts.orders": "postgresql://h/db.marts.orders", "other/raw": "postgresql://h/raw", "lost/thing": None,
    }
    rules = [(r.pattern, r.canonical) for r in health.suggested_patterns(found).collect()]
    assert sorted(rules) == [("other/{name}", "postgresql://h/{name}"), ("postgresql://h/marts.{table}", "postgresql://h/db.marts.{table}")]
    fixed = tables(spark, edges, tests, rules=rules)
    assert sorted(r.test_result_id for r in incidents.incident_view(fixed).collect()) == [1, 2]
    assert health.correlation_rate(health.health_stats(fixed)).first().correlation_rate == 1.0
    empty = tables(spark, edges, [])
    assert health.health_report(empty).first().correlation_rate == 1.0


def test_quality_checks_fail_when_they_should(spark):
    table = spark.createDataFrame([(1, "a", 5), (1, None, -1), (None, "b", 3)], "id int, name string, amount int")
    found = {(r.check_name, r.column_name): r.failures for r in quality.column_checks(table, ["id"], ["id", "name"]).collect()}
    assert found == {("not_null", "id"): 1, ("not_null", "name"): 1, ("unique", "id"): 1}
    suite = (("expect_table_row_count_to_be_between", None, 1, 2), ("expect_column_to_exist", "gone", None, None),
             ("expect_column_values_to_be_unique", "amount", None, None), ("expect_column_values_to_be_between", "amount", 0, None))
    got = {r.test_name: r.status for r in quality.run_expectations(table, suite).collect()}
    assert [got[s[0]] for s in suite] == ["failed", "failed", "passed", "failed"]
