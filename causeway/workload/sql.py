"""Intermediate tables of the checking SQL, each a CTE that ``compose`` adds where it is used.

The names of columns are those of the stored tables and of the reports, which both sides must give.
"""

from __future__ import annotations

import re

from causeway.workload import given

CANONICAL = r"regexp_replace({0}, '^postgresql://wh/s([^/]+)\.([^/]+)$', 'postgresql://wh/analytics.s\1.\2')"
AS_OF = f"TIMESTAMP '{given.AS_OF_TEXT}'"
TERMINAL = "('COMPLETE', 'FAIL', 'ABORT')"


def canonical(urn: str) -> str:
    return CANONICAL.format(urn)


def normalized(ns: str) -> str:
    scheme = f"lower(split_part({ns}, '://', 1))"
    rest = f"substr({ns}, strpos({ns}, '://') + 3)"
    host = rf"regexp_replace({rest}, '^((?:.*@)?[^/?]*):[^:/?]*([/?].*)?$', '\1\2')"
    return (
        f"CASE WHEN strpos({ns}, '://') = 0 THEN {ns} ELSE concat(CASE {scheme} WHEN 'postgres' THEN 'postgresql' "
        f"WHEN 's3a' THEN 's3' WHEN 's3n' THEN 's3' ELSE {scheme} END, '://', {host}) END"
    )


def table_name(urn: str) -> str:
    path = f"CASE WHEN strpos({urn}, '://') > 0 THEN substr({urn}, strpos({urn}, '://') + 3) ELSE {urn} END"
    leaf = f"list_last(string_split({path}, '/'))"
    stem = rf"regexp_replace({leaf}, '(?i)\.(parquet|csv|json|avro|orc)$', '')"
    return f"lower(list_last(string_split({stem}, '.')))"


def producer_name(url: str) -> str:
    parts = rf"string_split(regexp_replace({url}, '^https?://', ''), '/')"
    tool = f"list_position({parts}, 'integration')"
    return (
        f"CASE WHEN {url} = '' THEN 'unknown' WHEN len({parts}) >= 3 AND {parts}[1] = 'github.com' THEN "
        f"CASE WHEN coalesce({tool}, 0) > 0 AND {tool} < len({parts}) THEN "
        f"CASE WHEN {parts}[{tool} + 1] = 'common' THEN list_last({parts}) ELSE {parts}[{tool} + 1] END "
        f"ELSE {parts}[3] END ELSE {parts}[1] END"
    )


def producer_version(url: str) -> str:
    parts = rf"string_split(regexp_replace({url}, '^https?://', ''), '/')"
    tree = f"coalesce(list_position({parts}, 'tree'), 0)"
    after = rf"list_filter({parts}[{tree} + 1:], lambda p: regexp_matches(p, '^v?\d+\.\d+'))"
    return (
        f"CASE WHEN len({parts}) >= 3 AND {parts}[1] = 'github.com' THEN "
        f"CASE WHEN {tree} > 0 AND {tree} < len({parts}) THEN coalesce({after}[1], '') "
        rf"WHEN regexp_matches(coalesce({parts}[4], ''), '^v?\d+\.\d+') THEN {parts}[4] ELSE '' END ELSE '' END"
    )


def parsed_urn(urn: str) -> str:
    """(namespace, name, error) of a URN as three select items."""
    start = f"CASE WHEN strpos({urn}, '://') > 0 THEN strpos({urn}, '://') + 3 ELSE 1 END"
    found = f"strpos(substr({urn}, {start}), '/')"
    cut = f"({start} + {found} - 1)"
    error = (
        f"CASE WHEN {found} = 0 THEN 'missing_delimiter' WHEN {cut} = 1 THEN 'empty_namespace' "
        f"WHEN substr({urn}, {cut} + 1) = '' THEN 'empty_name' "
        f"WHEN substr({urn}, {cut} + 1) = '/' THEN 'empty_name_after_delimiter' END"
    )
    return (
        f"CASE WHEN {error} IS NULL THEN substr({urn}, 1, {cut} - 1) END AS namespace, "
        f"CASE WHEN {error} IS NULL THEN substr({urn}, {cut} + 1) END AS name, {error} AS error"
    )


REASON = r"""CASE WHEN event_type NOT IN ('START','RUNNING','COMPLETE','FAIL','ABORT','OTHER') THEN 'invalid_event_type'
  WHEN event_time IS NULL THEN 'missing_event_time' WHEN producer = '' THEN 'missing_producer'
  WHEN schema_url = '' THEN 'missing_schema_url'
  WHEN NOT regexp_matches(split_part(schema_url, '#', 1), '^https://openlineage\.io/spec/\d+-\d+-\d+/OpenLineage\.json$') THEN 'invalid_schema_url'
  WHEN run_id = '' THEN 'missing_run_id' WHEN job_namespace = '' THEN 'missing_job_namespace'
  WHEN job_name = '' THEN 'missing_job_name' END"""


def transition(before: str, after: str) -> str:
    return f"""CASE WHEN {before} IS NULL OR {before} = 'OTHER' OR {after} = 'OTHER' THEN NULL
  WHEN {before} IN {TERMINAL} THEN (CASE WHEN {before} <> {after} THEN 'terminal_state_immutable' END)
  WHEN {before} = 'START' AND {after} = 'START' THEN 'duplicate_start'
  WHEN {before} = 'RUNNING' AND {after} = 'START' THEN 'backward_transition'
  WHEN {before} IN ('START','RUNNING') AND {after} IN ('RUNNING','COMPLETE','FAIL','ABORT') THEN NULL
  ELSE 'invalid_transition' END"""


RETRY = "coalesce(nullif(CAST(test_root_parent_run_id AS VARCHAR), ''), CAST(test_result_id AS VARCHAR))"
GROUP = f"PARTITION BY test_name, dataset_urn, {RETRY}"


def _carried(alias: str, prefix: str) -> str:
    """The columns that a view row shows of a run's parent or root."""
    shown = {"job_name": "job_name", "job_namespace": "job_namespace", "current_state": "job_status",
             "completed_at": "job_completed_at", "producer_name": "producer_name"}
    return ", ".join(f"{alias}.{column} AS {prefix}_{name}" for column, name in shown.items())


CTES: dict[str, str] = {
    **{name: given.plain_text(name) for name in given.TEXTS},
    "rd": f"""SELECT raw_urn, {canonical('raw_urn')} AS canonical_urn FROM (SELECT dataset_urn AS raw_urn FROM datasets
  UNION SELECT dataset_urn FROM tests UNION SELECT dataset_urn FROM edges) u""",
    # Each run with what is known of the two runs above it; each written dataset with its run; then the pairs.
    "run_rows": f"""SELECT w.run_id AS job_run_id, w.job_name, w.job_namespace, w.current_state AS job_status, w.event_type AS job_event_type,
  w.started_at AS job_started_at, w.completed_at AS job_completed_at, w.producer_name AS job_producer_name, w.parent_run_id,
  w.root_parent_run_id, {_carried('above', 'parent')}, {_carried('top', 'root_parent')} FROM runs w
  LEFT JOIN runs above ON above.run_id = w.parent_run_id LEFT JOIN runs top ON top.run_id = w.root_parent_run_id""",
    "written": f"""SELECT {canonical('dataset_urn')} AS dataset_urn, dataset_urn AS produced_urn, dataset_name, dataset_namespace, run_rows.*
  FROM (SELECT dataset_urn, name AS dataset_name, namespace AS dataset_namespace FROM datasets) n
  JOIN (SELECT dataset_urn, run_id AS job_run_id FROM edges WHERE edge_type = 'output') e USING (dataset_urn) JOIN run_rows USING (job_run_id)""",
    "broken": f"""SELECT test_result_id, test_name, test_type, status AS test_status, message AS test_message, executed_at AS test_executed_at,
  duration_ms AS test_duration_ms, producer_name AS test_producer_name, {canonical('dataset_urn')} AS dataset_urn,
  (SELECT root_parent_run_id FROM runs WHERE runs.run_id = tests.run_id) AS test_root_parent_run_id
  FROM tests WHERE status = 'failed' OR status = 'error'""",
    "icv_all": "SELECT * FROM broken JOIN written USING (dataset_urn)",
    "one": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY test_result_id
  ORDER BY job_started_at DESC, job_run_id, produced_urn) AS rn FROM icv_all) x WHERE rn = 1""",
    "one_state": """SELECT o.*, ir.status AS resolution_status, ir.resolved_by, ir.resolution_reason, ir.mute_expires_at,
  ir.updated_at AS resolution_updated_at FROM one o LEFT JOIN resolutions ir ON o.test_result_id = ir.test_result_id""",
    "produced": f"SELECT DISTINCT {canonical('dataset_urn')} AS canonical_urn FROM edges WHERE edge_type = 'output'",
    "tested": """SELECT dataset_urn, count(*) AS test_count, max(executed_at) AS last_seen,
  coalesce(max(producer_name), '') AS producer FROM tests GROUP BY dataset_urn""",
    "lonely": f"SELECT * FROM tested WHERE {canonical('dataset_urn')} NOT IN (SELECT canonical_urn FROM produced)",
    "made_urns": """SELECT DISTINCT ON (le.dataset_urn) le.dataset_urn, coalesce(jr.producer_name, '') AS producer
  FROM edges le LEFT JOIN runs jr ON le.run_id = jr.run_id WHERE le.edge_type = 'output' ORDER BY le.dataset_urn, le.run_id""",
    "by_table": f"""SELECT DISTINCT ON (table_name) table_name, dataset_urn AS match_urn, producer AS match_producer
  FROM (SELECT *, {table_name('dataset_urn')} AS table_name FROM made_urns) m WHERE table_name <> ''
  ORDER BY table_name, dataset_urn""",
    "orphans": f"""SELECT l.*, b.match_urn, CASE WHEN b.match_urn IS NOT NULL THEN 1.0::DOUBLE END AS match_confidence,
  CASE WHEN b.match_urn IS NOT NULL THEN 'exact_table_name' END AS match_reason, b.match_producer
  FROM lonely l LEFT JOIN by_table b ON {table_name('l.dataset_urn')} = b.table_name""",
    "hops": """SELECT DISTINCT i.dataset_urn AS a, o.dataset_urn AS b FROM edges i JOIN edges o ON i.run_id = o.run_id
  WHERE i.edge_type = 'input' AND o.edge_type = 'output'""",
    "reach": """SELECT run_id, dataset_urn AS node, 0 AS depth FROM edges WHERE edge_type = 'output'
  UNION SELECT r.run_id, h.b, r.depth + 1 FROM reach r JOIN hops h ON r.node = h.a WHERE r.depth < 10""",
    "impact": """SELECT r.run_id, j.job_name, j.job_namespace, j.current_state AS job_status, r.node AS dataset_urn,
  d.name AS dataset_name, d.namespace AS dataset_namespace, r.depth, r.depth + 1 AS dataset_path_length
  FROM (SELECT run_id, node, min(depth) AS depth FROM reach GROUP BY run_id, node) r JOIN runs j ON r.run_id = j.run_id
  JOIN datasets d ON r.node = d.dataset_urn""",
    "counts": "SELECT run_id, count(DISTINCT dataset_urn) AS downstream_count FROM impact WHERE depth > 0 GROUP BY run_id",
    # Trees: first which datasets a run reaches on which level, then each reached dataset's steps.
    "steps_of": """SELECT DISTINCT i.dataset_urn AS a, o.dataset_urn AS b, coalesce((SELECT producer_name FROM runs r WHERE r.run_id = o.run_id), '')
  AS producer FROM edges i JOIN edges o ON i.run_id = o.run_id AND i.dataset_urn <> o.dataset_urn
  WHERE i.edge_type = 'input' AND o.edge_type = 'output'""",
    "below": """SELECT run_id, dataset_urn AS node, 0 AS level FROM edges WHERE edge_type = 'output'
  UNION SELECT run_id, b, level + 1 FROM below JOIN hops ON a = node AND a <> b WHERE level < 9""",
    "down_tree": """SELECT DISTINCT run_id, b AS dataset_urn, (SELECT name FROM datasets d WHERE d.dataset_urn = b) AS dataset_name,
  level + 1 AS depth, a AS parent_urn, producer FROM below JOIN steps_of ON a = node""",
    "up_starts": "SELECT DISTINCT dataset_urn AS start_urn, job_run_id AS run_id FROM one",
    "above_of": """SELECT run_id, dataset_urn AS node, 1 AS level FROM edges WHERE edge_type = 'input' AND run_id IN (SELECT run_id FROM up_starts)
  UNION SELECT run_id, a, level + 1 FROM above_of JOIN hops ON b = node AND a <> b WHERE level < 9""",
    "up_rows": """SELECT start_urn, run_id, node AS dataset_urn, 1 AS depth, start_urn AS child_urn FROM above_of JOIN up_starts USING (run_id) WHERE level = 1
  UNION SELECT start_urn, run_id, a, level + 1, node FROM above_of JOIN hops ON b = node AND a <> b JOIN up_starts USING (run_id)""",
    "writers": """SELECT DISTINCT e.dataset_urn, coalesce(r.producer_name, '') AS producer FROM edges e LEFT JOIN runs r USING (run_id)
  WHERE e.edge_type = 'output'""",
    "up_tree": """SELECT start_urn, run_id, dataset_urn, name AS dataset_name, depth, child_urn, coalesce(producer, '') AS producer
  FROM up_rows JOIN (SELECT dataset_urn, name FROM datasets) d USING (dataset_urn) LEFT JOIN writers USING (dataset_urn)""",
    "chain": """SELECT c.run_id, p.run_id AS ancestor_run_id, 1 AS depth, p.job_name, p.job_namespace, p.producer_name,
  p.current_state AS status, p.parent_run_id AS nxt FROM runs c JOIN runs p ON p.run_id = c.parent_run_id
  UNION ALL SELECT c.run_id, p.run_id, c.depth + 1, p.job_name, p.job_namespace, p.producer_name, p.current_state, p.parent_run_id
  FROM chain c JOIN runs p ON p.run_id = c.nxt WHERE c.depth < 10""",
    # Events, step by step as a request handler would treat them.
    "probe": """SELECT batch_id, arrival, ingested_at, j FROM (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j
  FROM messages) m WHERE json_type(j, '$.eventType') = 'VARCHAR'""",
    "ev0": """SELECT batch_id, arrival, ingested_at, j, trim(coalesce(j->>'$.eventType', '')) AS event_type,
  trim(coalesce(j->>'$.eventTime', '')) AS tt, trim(coalesce(j->>'$.producer', '')) AS producer,
  trim(coalesce(j->>'$.schemaURL', '')) AS schema_url, trim(coalesce(j->>'$.run.runId', '')) AS run_id,
  trim(coalesce(j->>'$.job.namespace', '')) AS job_namespace, trim(coalesce(j->>'$.job.name', '')) AS job_name,
  CASE WHEN json_type(j, '$.run.facets.parent.run.runId') = 'VARCHAR' THEN j->>'$.run.facets.parent.run.runId' ELSE '' END AS parent_id,
  CASE WHEN json_type(j, '$.run.facets.parent.root.run.runId') = 'VARCHAR' THEN j->>'$.run.facets.parent.root.run.runId' ELSE '' END AS root_id
  FROM probe""",
    "ev1": """SELECT *, CASE WHEN tt LIKE '%+02:00' THEN TRY_CAST(replace(tt, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR
    ELSE TRY_CAST(replace(replace(tt, 'Z', ''), '+00:00', '') AS TIMESTAMP) END AS event_time,
  CASE WHEN tt = 'not-a-time' THEN NULL WHEN tt LIKE '%+02:00' THEN replace(tt, '.250+', '.25+')
    WHEN tt LIKE '%+00:00' THEN replace(tt, '+00:00', 'Z') WHEN tt LIKE '%Z' THEN tt ELSE concat(tt, 'Z') END AS event_time_text
  FROM ev0""",
    "ev": """SELECT *, sha256(concat(producer, job_namespace, job_name, run_id, coalesce(event_time_text, '0001-01-01T00:00:00Z'),
  event_type)) AS idempotency_key FROM ev1""",
    "single": """SELECT batch_id, count(*) AS event_count, min(run_id) AS run_id, min(arrival) AS first_arrival FROM ev GROUP BY batch_id
  HAVING count(*) > 1 AND count(DISTINCT run_id) = 1""",
    "ordered": """SELECT e.*, s.first_arrival, coalesce(e.event_time, TIMESTAMP '0001-01-01') AS sort_time FROM ev e
  JOIN single s ON e.batch_id = s.batch_id""",
    "steps": """SELECT *, lag(event_type) OVER (PARTITION BY batch_id ORDER BY sort_time, arrival) AS before,
  row_number() OVER (PARTITION BY batch_id ORDER BY sort_time, arrival) AS n FROM ordered WHERE event_type <> 'OTHER'""",
    "verdicts": f"""SELECT s.batch_id, s.run_id, s.event_count, s.first_arrival,
  (SELECT arg_min(problem, n) FROM (SELECT n, {transition('before', 'event_type')} AS problem FROM steps t
     WHERE t.batch_id = s.batch_id) q WHERE problem IS NOT NULL) AS sequence_error,
  coalesce((SELECT arg_max(event_type, n) FROM steps t WHERE t.batch_id = s.batch_id), 'OTHER') AS final_state FROM single s""",
    # The n-th event in time takes the n-th place that its batch has in the order of arrival.
    "trade": """SELECT t.arrival, p.arrival AS new_arrival FROM (SELECT batch_id, arrival, row_number() OVER (PARTITION BY batch_id
    ORDER BY sort_time, arrival) AS n FROM ordered) t JOIN (SELECT batch_id, arrival, row_number() OVER (PARTITION BY batch_id
    ORDER BY arrival) AS n FROM ordered) p ON t.batch_id = p.batch_id AND t.n = p.n""",
    "placed": """SELECT e.* EXCLUDE (arrival), coalesce(o.new_arrival, e.arrival) AS arrival, v.sequence_error FROM ev e
  LEFT JOIN (SELECT batch_id, sequence_error FROM verdicts) v ON e.batch_id = v.batch_id LEFT JOIN trade o ON e.arrival = o.arrival""",
    "checked": f"""SELECT *, coalesce(CASE WHEN sequence_error IS NOT NULL THEN concat('invalid_sequence:', sequence_error) END, {REASON})
  AS reject_reason FROM placed""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival) AS n FROM checked WHERE reject_reason IS NULL""",
    "walk": f"""SELECT run_id, n, arrival, event_type AS st, event_time AS tm, false AS refused FROM ranked WHERE n = 1
  UNION ALL SELECT r.run_id, r.n, r.arrival,
    CASE WHEN r.event_time > w.tm AND NOT (w.st IN {TERMINAL} AND w.st <> r.event_type) THEN r.event_type ELSE w.st END,
    CASE WHEN r.event_time > w.tm AND NOT (w.st IN {TERMINAL} AND w.st <> r.event_type) THEN r.event_time ELSE w.tm END,
    r.event_time > w.tm AND w.st IN {TERMINAL} AND w.st <> r.event_type
  FROM walk w JOIN ranked r ON r.run_id = w.run_id AND r.n = w.n + 1""",
    "copies": """SELECT r.*, row_number() OVER (PARTITION BY r.idempotency_key ORDER BY r.arrival) AS c FROM ranked r
  JOIN walk w ON r.arrival = w.arrival WHERE NOT w.refused""",
    "taken": """SELECT idempotency_key, c, arrival, ingested_at AS since, true AS kept FROM copies WHERE c = 1
  UNION ALL SELECT n.idempotency_key, n.c, n.arrival,
    CASE WHEN n.ingested_at >= t.since + INTERVAL 24 HOUR THEN n.ingested_at ELSE t.since END,
    n.ingested_at >= t.since + INTERVAL 24 HOUR FROM taken t
  JOIN copies n ON n.idempotency_key = t.idempotency_key AND n.c = t.c + 1""",
    "stored": "SELECT e.* FROM copies e JOIN taken t ON e.arrival = t.arrival WHERE t.kept",
    "dsets": """SELECT arrival, run_id, event_time, producer, 'output' AS edge_type, pos AS p, d FROM (SELECT *,
    unnest(CAST(j->'$.outputs' AS JSON[])) AS d, generate_subscripts(CAST(j->'$.outputs' AS JSON[]), 1) AS pos FROM stored) a
  UNION ALL SELECT arrival, run_id, event_time, producer, CASE WHEN coalesce(json_array_length(j, '$.outputs'), 0) = 0 THEN 'check' ELSE 'input' END,
    1000 + pos, d FROM (SELECT *, unnest(CAST(j->'$.inputs' AS JSON[])) AS d,
    generate_subscripts(CAST(j->'$.inputs' AS JSON[]), 1) AS pos FROM stored) b""",
    "ment": f"""SELECT *, concat(namespace, '/', name) AS dataset_urn FROM (SELECT *, {normalized("trim(d->>'$.namespace')")} AS namespace,
  trim(d->>'$.name') AS name FROM dsets) m""",
    "facet_rows": """SELECT dataset_urn, arrival, p, k AS facet, CAST(f->k AS VARCHAR) AS value FROM (SELECT *, d->'$.facets' AS f,
    unnest(CASE WHEN json_type(d, '$.facets') = 'OBJECT' THEN json_keys(d, '$.facets') ELSE [] END) AS k FROM ment WHERE edge_type <> 'check') a
  UNION ALL SELECT dataset_urn, arrival, p, concat('output_', k), CAST(f->k AS VARCHAR) FROM (SELECT *, d->'$.outputFacets' AS f,
    unnest(CASE WHEN json_type(d, '$.outputFacets') = 'OBJECT' THEN json_keys(d, '$.outputFacets') ELSE [] END) AS k FROM ment WHERE edge_type = 'output') b
  UNION ALL SELECT dataset_urn, arrival, p, concat('input_', k), CAST(f->k AS VARCHAR) FROM (SELECT *, d->'$.inputFacets' AS f,
    unnest(CASE WHEN json_type(d, '$.inputFacets') = 'OBJECT' THEN json_keys(d, '$.inputFacets') ELSE [] END) AS k FROM ment WHERE edge_type = 'input') c""",
    "asserted": """SELECT arrival, p, dataset_urn, run_id, event_time, producer, rank, field, test_type,
    unnest(CASE WHEN json_type(body, '$.assertions') = 'ARRAY' THEN CAST(body->'$.assertions' AS JSON[]) ELSE [] END) AS a,
    generate_subscripts(CASE WHEN json_type(body, '$.assertions') = 'ARRAY' THEN CAST(body->'$.assertions' AS JSON[]) ELSE [] END, 1) AS ap
  FROM (SELECT *, d->'$.inputFacets.dataQualityAssertions' AS body, 0 AS rank, 'assertion' AS field, 'dataQualityAssertion' AS test_type
      FROM ment WHERE edge_type <> 'output'
    UNION ALL SELECT *, d->'$.inputFacets.greatExpectations_assertions', 1, 'expectationType', 'greatExpectationsAssertion'
      FROM ment WHERE edge_type <> 'output') x""",
    "tests_found": f"""SELECT CASE WHEN json_type(a, concat('$.', field)) = 'VARCHAR' THEN a->>concat('$.', field) END AS test_name, test_type,
  dataset_urn, run_id, CASE WHEN json_type(a, '$.success') = 'BOOLEAN' AND a->>'$.success' = 'true' THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN coalesce(a->>'$.severity', '') <> '' THEN concat('severity=', a->>'$.severity')
    WHEN coalesce(a->>'$.column', '') <> '' THEN concat('column=', a->>'$.column') END AS metadata,
  event_time AS executed_at, {producer_name('producer')} AS producer_name, nullif({producer_version('producer')}, '') AS producer_version,
  arrival, p, rank, ap FROM asserted""",
    "tests_named": "SELECT * FROM tests_found WHERE coalesce(test_name, '') <> ''",
    # Resolution requests.
    "req": """SELECT seq, test_result_id, status, note, resolved_by, requested_at,
  CASE WHEN status = 'resolved' THEN (CASE WHEN reason = '' THEN 'manual' ELSE reason END) WHEN status = 'muted' THEN reason ELSE '' END AS reason,
  CASE WHEN status = 'muted' THEN (CASE WHEN mute_days <= 0 THEN 30 ELSE mute_days END) END AS mute_days,
  CASE WHEN status = '' THEN 'status_required' WHEN status NOT IN ('open','acknowledged','resolved','muted') THEN 'status_unknown'
    WHEN status = 'open' THEN 'cannot_reopen' WHEN status = 'muted' AND reason = '' THEN 'mute_reason_required'
    WHEN status = 'muted' AND mute_days > 365 THEN 'mute_days_too_long' END AS request_error FROM requests""",
}


# All run events of a stream, without looking at rules: which copies are kept.
CTES["copies_ev"] = "SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival) AS c FROM ev"
CTES["taken_ev"] = CTES["taken"].replace("copies", "copies_ev").replace("taken t", "taken_ev t")
# The same steps for messages of a stream, where no sequences are checked.
CTES["checked_k"] = f"SELECT *, {REASON} AS reject_reason FROM ev"
_STREAM_STEPS = ("ranked", "walk", "copies", "taken", "stored", "dsets", "ment", "facet_rows", "asserted", "tests_found", "tests_named")


def on_stream(text: str, names: tuple[str, ...] = (*_STREAM_STEPS, "checked")) -> str:
    """A text over the stream's versions of the named relations."""
    return re.sub(rf"\b({'|'.join(names)})\b", r"\1_k", text)


for _step in _STREAM_STEPS:
    CTES[f"{_step}_k"] = on_stream(CTES[_step])

RUNS_FOLD = f"""SELECT s.run_id, arg_min(trim(j->>'$.job.name'), s.arrival) AS job_name, arg_min(job_namespace, s.arrival) AS job_namespace,
  arg_max(event_type, (event_time, -s.arrival)) AS current_state, max(event_time) AS event_time, arg_min(event_time, s.arrival) AS started_at,
  CASE WHEN arg_max(event_type, (event_time, -s.arrival)) IN {TERMINAL} THEN max(event_time) END AS completed_at,
  arg_max(parent_id, s.arrival) FILTER (WHERE parent_id <> '') AS parent_run_id,
  arg_max(root_id, s.arrival) FILTER (WHERE root_id <> '') AS root_parent_run_id,
  {producer_name('arg_min(producer, s.arrival)')} AS producer_name,
  coalesce(arg_max(v, s.arrival) FILTER (WHERE v <> ''), '') AS producer_version
  FROM (SELECT *, {producer_version('producer')} AS v FROM stored) s GROUP BY s.run_id"""
DATASETS_FOLD = """SELECT dataset_urn, arg_min(name, (arrival, p)) AS name, arg_min(namespace, (arrival, p)) AS namespace,
  arg_max(run_id, (arrival, p)) FILTER (WHERE edge_type = 'output') AS last_producing_run_id FROM ment GROUP BY dataset_urn"""
FACETS_FOLD = """SELECT DISTINCT ON (dataset_urn, facet) dataset_urn, facet, value FROM facet_rows
  ORDER BY dataset_urn, facet, arrival DESC, p DESC"""
EDGES_FOLD = "SELECT DISTINCT run_id, dataset_urn, CASE WHEN edge_type = 'output' THEN 'output' ELSE 'input' END AS edge_type FROM ment"
TESTS_FOLD = """SELECT DISTINCT ON (test_name, dataset_urn, run_id) md5(concat(test_name, chr(31), dataset_urn, chr(31), run_id)) AS test_result_id,
  test_name, dataset_urn, run_id, test_type, status, metadata, executed_at, producer_name, producer_version, arrival FROM tests_named
  ORDER BY test_name, dataset_urn, run_id, arrival DESC, p DESC, rank DESC, ap DESC"""
HISTORY_FOLD = """SELECT x.run_id, x.arrival, prev AS from_state, st AS to_state, tm AS event_time, r.ingested_at AS updated_at FROM
  (SELECT run_id, arrival, st, tm, n, lag(st) OVER (PARTITION BY run_id ORDER BY n) AS prev FROM walk) x
  JOIN ranked r ON r.arrival = x.arrival WHERE prev IS NULL OR prev <> st"""
# The tables that a stream leaves, and the reports over them.
CTES["runs_k"] = f"SELECT *, current_state AS event_type FROM ({on_stream(RUNS_FOLD)}) r"
CTES["datasets_k"] = on_stream(DATASETS_FOLD)
CTES["edges_k"] = on_stream(EDGES_FOLD)
CTES["tests_k"] = f"SELECT *, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS INTEGER) AS duration_ms FROM ({on_stream(TESTS_FOLD)}) t"
_REPORT_STEPS = ("rd", "run_rows", "written", "broken", "icv_all", "hops", "reach", "impact")
for _step in _REPORT_STEPS:
    CTES[f"{_step}_k"] = on_stream(CTES[_step], (*_REPORT_STEPS, "runs", "datasets", "edges", "tests"))


def compose(body: str) -> str:
    """``body`` with every CTE it needs, in the order of CTES."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(definition)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH RECURSIVE {parts}\n{body}"
