"""The write path: folds of events into tables, duplicates, resolutions, sinks and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causeway.operators import resolution, runs, tables, validation
from causeway.operators.ingest import key_text, settle
from causeway.plans import incidents
from causeway.workload.registry import Given, query
from causeway.sources.table_store import ExpiringKeys
from causeway.workload import given, sql

_OUTCOMES = """SELECT c.batch_id, c.arrival, CASE WHEN c.reject_reason IS NOT NULL OR w.refused THEN 'rejected' WHEN t.kept THEN 'stored'
  ELSE 'duplicate' END AS outcome FROM checked c LEFT JOIN walk w ON c.arrival = w.arrival AND c.reject_reason IS NULL
  LEFT JOIN taken t ON c.arrival = t.arrival AND c.reject_reason IS NULL"""


@query("a6_batch_summary", f"""SELECT batch_id, count(*) AS received, count(*) FILTER (WHERE outcome <> 'rejected') AS successful,
  count(*) FILTER (WHERE outcome = 'rejected') AS failed, CAST(0 AS BIGINT) AS retriable, count(*) FILTER (WHERE outcome = 'rejected') AS non_retriable,
  CASE WHEN count(*) FILTER (WHERE outcome = 'rejected') = 0 THEN 'success' WHEN count(*) FILTER (WHERE outcome <> 'rejected') > 0
    THEN 'partial_success' ELSE 'error' END AS status FROM ({_OUTCOMES}) o GROUP BY batch_id""")
def batch_summary(g: Given):
    return validation.batch_summary(g.ingested.outcomes)


@query("j1_run_upsert", f"SELECT r.* EXCLUDE (current_state), w.st AS current_state FROM ({sql.RUNS_FOLD}) r JOIN "
       "(SELECT run_id, arg_max(st, n) AS st FROM walk GROUP BY run_id) w ON r.run_id = w.run_id")
def run_upsert(g: Given):
    return g.ingested.tables.runs.drop("metadata", "event_type")


@query("j2_refused", "SELECT arrival, run_id FROM walk WHERE refused")
def refused(g: Given):
    checked = g.scratch.cut(_valid(g, "run_id", "event_type", "event_time"))
    return runs.refused_events(checked)


def _valid(g: Given, *columns: str):
    """Fields of the valid events, under the arrival that these are stored with."""
    heads = validation.validate_events(g.heads)
    names = dict.fromkeys(("batch_id", "run_id", "arrival", "event_type", "event_time", "reject_reason", *columns))
    checked = validation.check_sequences(g.scratch.cut(heads.select(*names)), g.scratch)
    return checked.filter("reject_reason IS NULL").select("arrival", *columns)


@query("j3_state_history", sql.HISTORY_FOLD)
def state_history(g: Given):
    return runs.state_changes(g.ingested.heads)


@query("j4_produced_facets", sql.FACETS_FOLD)
def produced_facets(g: Given):
    return tables.fold_entries(g.ingested.keep(tables.facet_entries(g.events)))


@query("j5_datasets", sql.DATASETS_FOLD)
def datasets(g: Given):
    return g.ingested.tables.datasets.drop("facets")


@query("j6_bare_datasets", """SELECT m.dataset_urn, count(*) FILTER (WHERE edge_type = 'check') AS checks, false AS has_facets FROM ment m
  GROUP BY m.dataset_urn HAVING m.dataset_urn NOT IN (SELECT dataset_urn FROM facet_rows)""")
def bare_datasets(g: Given):
    """Datasets nothing but checks have mentioned: a row without facets and without a producer."""
    checks = tables.mentions(g.events).filter("edge_type = 'input' AND is_validator").select("arrival", "dataset_urn")
    counted = g.ingested.keep(checks).groupBy("dataset_urn").agg(F.count(F.lit(1)).alias("checks"))
    bare = g.ingested.tables.datasets.withColumn("has_facets", F.size("facets") > 0).filter("NOT has_facets")
    return bare.join(counted, "dataset_urn", "left").select(
        "dataset_urn", F.coalesce("checks", F.lit(0).cast("bigint")).alias("checks"), "has_facets"
    )


@query("j7_edges", sql.EDGES_FOLD)
def edges(g: Given):
    return g.ingested.tables.edges


@query("j8_extract_tests", "SELECT test_name, test_type, dataset_urn, run_id, status, metadata, executed_at, producer_name, producer_version, arrival FROM tests_named")
def extract_tests(g: Given):
    found = tables.extract_tests(g.asserting).withColumn("metadata", _flat(F.col("metadata"))).select(
        "test_name", "test_type", "dataset_urn", "run_id", "status", "metadata", "executed_at", "producer_name",
        "producer_version", "arrival",
    )
    return g.ingested.keep(found)


def _flat(metadata):
    return F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query("j9_test_upsert", f"SELECT * EXCLUDE (producer_name, producer_version) FROM ({sql.TESTS_FOLD}) t")
def test_upsert(g: Given):
    return g.ingested.tables.tests.withColumn("metadata", _flat(F.col("metadata"))).select(
        "test_result_id", "test_name", "dataset_urn", "run_id", "test_type", "status", "metadata", "executed_at", "arrival"
    )


@query("j10_resolved_datasets", "SELECT raw_urn, canonical_urn FROM rd")
def resolved_datasets(g: Given):
    return incidents.resolved_datasets(g.tables)


@query("j11_dedup", "SELECT idempotency_key, arrival, since AS ingested_at, since + INTERVAL 24 HOUR AS expires_at FROM taken WHERE kept")
def dedup_events(g: Given):
    settled = settle(g.heads, g.scratch)
    return settled.keyed(settled.copies).select(key_text(), "arrival", "ingested_at", "expires_at")


@query("j12_live_keys", f"""SELECT idempotency_key, since + INTERVAL 24 HOUR AS expires_at, true AS in_a_live_month FROM taken
  WHERE kept AND since + INTERVAL 24 HOUR >= {sql.AS_OF} - INTERVAL 15 DAY""")
def live_keys(g: Given):
    """The keys of all stored events, laid out by month; the months before a moment are dropped, and what is left is read."""
    keys = ExpiringKeys(g.spark, f"{g.scratch.root}/keys", StructType.fromDDL("idempotency_key binary, expires_at timestamp"), "month")
    settled = g.ingested.settled
    keys.write(settled.keyed(settled.copies).select("idempotency_key", "expires_at"), 0)
    since = dt.datetime.fromisoformat(given.AS_OF_TEXT) - dt.timedelta(days=15)
    keys.expire(since)
    return keys.alive(since).select(key_text(), "expires_at", F.lit(keys.expired(since).isEmpty()).alias("in_a_live_month"))


_KEYS = """keyed AS (SELECT test_result_id, test_name, dataset_urn, test_root_parent_run_id AS root,
  coalesce((SELECT status FROM resolutions r WHERE r.test_result_id = o.test_result_id), 'open') AS s0 FROM one o)"""


def _fold(cascade: bool) -> str:
    """Requests one after another: each pass of the recursion applies one request to one group."""
    group = ("CASE WHEN root IS NOT NULL THEN concat('g', test_name, '|', dataset_urn, '|', root) ELSE concat('i', test_result_id) END"
             if cascade else "concat('i', test_result_id)")
    return f"""WITH RECURSIVE {_KEYS}, grouped AS (SELECT *, {group} AS gk FROM keyed),
  queued AS (SELECT r.*, g.gk, row_number() OVER (PARTITION BY g.gk ORDER BY r.seq) AS n FROM req r JOIN grouped g
    ON r.test_result_id = g.test_result_id WHERE r.request_error IS NULL),
  fold AS (SELECT gk, CAST(0 AS BIGINT) AS n, map_from_entries(list((test_result_id, s0))) AS states,
      CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS accepted FROM grouped WHERE gk IN (SELECT gk FROM queued) GROUP BY gk
    UNION ALL SELECT f.gk, q.n, CASE WHEN ok THEN map_from_entries(list_transform(map_entries(f.states), lambda e:
        (e.key, CASE WHEN (q.status = 'acknowledged' AND e.value = 'open') OR (q.status <> 'acknowledged' AND e.value IN ('open', 'acknowledged'))
           THEN q.status ELSE e.value END))) ELSE f.states END, q.seq, ok
    FROM (SELECT f0.gk, f0.n, f0.states, q0.seq AS qseq, CASE WHEN q0.status = 'acknowledged' THEN f0.states[q0.test_result_id] = 'open'
        ELSE f0.states[q0.test_result_id] IN ('open', 'acknowledged') END AS ok FROM fold f0 JOIN queued q0 ON q0.gk = f0.gk AND q0.n = f0.n + 1) f
    JOIN queued q ON q.seq = f.qseq)"""


def _after(cascade: bool) -> str:
    """The resolution table after the fold, with the request that last moved each incident."""
    return f"""{_fold(cascade)},
  moved AS (SELECT e.key AS test_result_id, gk, f.n, f.seq, e.value AS st, lag(e.value) OVER (PARTITION BY e.key ORDER BY f.n) AS before
    FROM (SELECT *, unnest(map_entries(states)) AS e FROM fold) f),
  lastmove AS (SELECT test_result_id, arg_max(seq, n) AS seq FROM moved WHERE before IS NOT NULL AND before <> st GROUP BY test_result_id)
  SELECT l.test_result_id, r.status, r.resolved_by, r.reason AS resolution_reason, r.note AS resolution_note,
    CAST(NULL AS BIGINT) AS resolved_by_test_result_id,
    CASE WHEN r.status = 'muted' THEN r.requested_at + to_days(r.mute_days) END AS mute_expires_at, r.requested_at AS updated_at
  FROM lastmove l JOIN req r ON l.seq = r.seq
  UNION ALL SELECT * FROM resolutions WHERE test_result_id NOT IN (SELECT test_result_id FROM lastmove)"""


@query("j13_set_resolution", f"SELECT * FROM ({_after(False)}) x")
def set_resolution(g: Given):
    return resolution.apply_requests(incidents.incident_keys(g.tables), g["resolutions"], g.requests, cascade=False)


@query("j14_request_rules", "SELECT seq, status, reason, mute_days, request_error FROM req")
def request_rules(g: Given):
    return g.requests.select("seq", "status", "reason", "mute_days", "request_error")


@query("j15_cascade", f"SELECT * FROM ({_after(True)}) x")
def cascade(g: Given):
    return resolution.apply_requests(incidents.incident_keys(g.tables), g["resolutions"], g.requests)


@query("j15_request_outcomes", f"""SELECT r.seq, r.test_result_id, r.status, r.request_error, CASE WHEN r.request_error IS NOT NULL THEN 'invalid'
  WHEN r.test_result_id NOT IN (SELECT test_result_id FROM one) THEN 'not_found' WHEN f.accepted THEN 'accepted' ELSE 'conflict' END AS outcome
  FROM req r LEFT JOIN (SELECT * FROM ({_fold(True)} SELECT seq, accepted FROM fold WHERE seq IS NOT NULL) z) f ON r.seq = f.seq""")
def request_outcomes(g: Given):
    return resolution.request_outcomes(incidents.incident_keys(g.tables), g["resolutions"], g.requests)


_AUTO = f"""SELECT f.test_result_id, min(p.test_result_id) AS resolved_by_test_result_id FROM tests f JOIN tests p
  ON f.test_name = p.test_name AND f.dataset_urn = p.dataset_urn AND p.status = 'passed'
  LEFT JOIN resolutions r ON f.test_result_id = r.test_result_id
  WHERE f.status IN ('failed', 'error') AND (r.status IS NULL OR r.status IN ('open', 'acknowledged'))
    AND f.executed_at < {sql.AS_OF} - INTERVAL 1 HOUR GROUP BY f.test_result_id"""


@query("d8_auto_resolve_join", _AUTO)
def auto_resolve_join(g: Given):
    tests = g["tests"]
    return resolution.auto_resolved(tests, tests.filter("status = 'passed'"), g["resolutions"], g.as_of)


@query("j16_auto_resolve", f"""SELECT a.test_result_id, 'resolved' AS status, 'auto' AS resolved_by, 'auto_pass' AS resolution_reason,
  r.resolution_note, a.resolved_by_test_result_id, r.mute_expires_at, {sql.AS_OF} AS updated_at FROM ({_AUTO}) a
  LEFT JOIN resolutions r ON a.test_result_id = r.test_result_id
  UNION ALL SELECT test_result_id, status, resolved_by, resolution_reason, resolution_note, resolved_by_test_result_id, mute_expires_at, updated_at
  FROM resolutions WHERE test_result_id NOT IN (SELECT test_result_id FROM ({_AUTO}) b)""")
def auto_resolve(g: Given):
    tests = g["tests"]
    return resolution.auto_resolve(tests, tests.filter("status = 'passed'"), g["resolutions"], g.as_of)


@query("j17_current_resolution", """SELECT o.test_result_id, coalesce(r.status, 'open') AS status, r.resolved_by FROM one o
  LEFT JOIN resolutions r ON o.test_result_id = r.test_result_id""")
def current_resolution(g: Given):
    state = resolution.current_resolution(incidents.incident_keys(g.tables), g["resolutions"])
    return state.select("test_result_id", "status", "resolved_by")


@query("j18_mute_expired", f"""SELECT o.test_result_id, coalesce(r.status = 'muted' AND r.mute_expires_at < {sql.AS_OF}, false) AS mute_expired
  FROM one o LEFT JOIN resolutions r ON o.test_result_id = r.test_result_id""")
def mute_expired(g: Given):
    state = resolution.current_resolution(incidents.incident_keys(g.tables), g["resolutions"], g.as_of)
    return state.select("test_result_id", "mute_expired")
