"""Lineage tables and raw event messages derived from the given tables.

The texts below run unchanged in Spark and in the SQL engine that checks the results:
every row comes from a row of ``orders`` or ``events``, so all inputs grow with them.
``{orders}`` and ``{events}`` stand for those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.aliases import AliasResolver
from causeway.plans.incidents import Tables
from causeway.session import tune

AS_OF_TEXT = "2024-01-31 00:00:00"
ALIAS_RULES = (("postgresql://wh/s{n}.{table}", "postgresql://wh/analytics.s{n}.{table}"),)


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


RUNS = """
SELECT k AS run_id, concat('job_', c % 40) AS job_name,
  CASE WHEN k % 3 = 0 THEN 'airflow://prod' WHEN k % 3 = 1 THEN 'dbt://prod' ELSE 'spark://prod' END AS job_namespace,
  st AS current_state, st AS event_type, t0 + INTERVAL '1' HOUR AS event_time, t0 AS started_at,
  CASE WHEN st <> 'RUNNING' THEN t0 + INTERVAL '1' HOUR END AS completed_at,
  CASE WHEN k > 0 THEN CAST(floor(k / 4) AS BIGINT) END AS parent_run_id,
  CASE WHEN k >= 64 THEN CAST(floor(k / 64) AS BIGINT) END AS root_parent_run_id,
  CASE WHEN k % 3 = 0 THEN 'airflow' WHEN k % 3 = 1 THEN 'dbt-core' ELSE 'spark' END AS producer_name
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) AS t0,
        CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'COMPLETE' ELSE 'RUNNING' END AS st FROM {orders}) o
"""

DATASETS = """
SELECT concat('postgresql://wh/analytics.s', o_orderkey % 5, '.t', o_orderkey) AS dataset_urn,
  concat('analytics.s', o_orderkey % 5, '.t', o_orderkey) AS name, 'postgresql://wh' AS namespace,
  o_orderkey AS last_producing_run_id
FROM {orders}
"""

EDGES = """
SELECT k AS run_id, concat('postgresql://wh/analytics.s', d % 5, '.t', d) AS dataset_urn, edge_type FROM (
  SELECT o_orderkey AS k, o_orderkey AS d, 'output' AS edge_type FROM {orders}
  UNION ALL SELECT o_orderkey, o_orderkey - 1, 'output' FROM {orders} WHERE o_orderkey % 11 = 0 AND o_orderkey > 0
  UNION ALL SELECT o_orderkey, CAST(floor(o_orderkey / 3) AS BIGINT), 'input' FROM {orders} WHERE o_orderkey > 0
  UNION ALL SELECT o_orderkey, CAST(floor(o_orderkey / 3) AS BIGINT) + 1, 'input' FROM {orders}
    WHERE o_orderkey % 7 = 0 AND o_orderkey > 3) e
"""

TESTS = """
SELECT e AS test_result_id, concat('test_', h % 2) AS test_name, 'data_quality' AS test_type,
  CASE WHEN dk % 10 = 9 THEN concat('demo_wh/analytics.s', dk % 5, '.t', dk)
       WHEN dk % 3 = 0 THEN concat('postgresql://wh/s', dk % 5, '.t', dk)
       ELSE concat('postgresql://wh/analytics.s', dk % 5, '.t', dk) END AS dataset_urn,
  e AS run_id, status, concat('saw ', user_id) AS message, ts AS executed_at, CAST(e % 1000 AS INT) AS duration_ms,
  CASE WHEN e % 4 = 0 THEN 'dbt-core' ELSE 'great_expectations' END AS producer_name, e AS arrival
FROM (SELECT event_id AS e, CAST(floor(event_id / 2) AS BIGINT) AS h, CAST(floor(event_id / 4) AS BIGINT) AS dk, user_id,
        CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'failed' WHEN 'click' THEN 'passed'
          WHEN 'view' THEN 'warning' ELSE 'skipped' END AS status FROM {events}) t
"""

RESOLUTIONS = """
SELECT event_id AS test_result_id,
  CASE event_id % 9 WHEN 0 THEN 'acknowledged' WHEN 3 THEN 'resolved' ELSE 'muted' END AS status,
  concat('user', user_id % 7) AS resolved_by,
  CASE event_id % 9 WHEN 0 THEN '' WHEN 3 THEN 'manual' ELSE 'expected' END AS resolution_reason,
  '' AS resolution_note, CAST(NULL AS BIGINT) AS resolved_by_test_result_id,
  CASE WHEN event_id % 9 = 6 THEN CAST(ts AS TIMESTAMP) + INTERVAL '9' DAY END AS mute_expires_at,
  CAST(ts AS TIMESTAMP) + INTERVAL '1' DAY AS updated_at
FROM {events} WHERE event_type IN ('error', 'purchase') AND event_id % 3 = 0
"""

REQUESTS = """
SELECT event_id AS seq,
  CASE event_id % 3 WHEN 1 THEN event_id WHEN 2 THEN event_id - 1 ELSE event_id - 62 END AS test_result_id,
  CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'error' THEN 'resolved' WHEN 'purchase' THEN 'muted'
    WHEN 'view' THEN (CASE WHEN event_id % 4 = 1 THEN 'open' WHEN event_id % 4 = 2 THEN 'resolved' ELSE 'muted' END)
    ELSE (CASE WHEN event_id % 4 = 3 THEN 'closed' WHEN event_id % 4 = 2 THEN '' ELSE 'acknowledged' END) END AS status,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'expected' END AS reason, concat('note ', event_id % 3) AS note,
  CAST(CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 13 = 1 THEN 400 ELSE event_id % 60 END AS INT) AS mute_days,
  concat('user', user_id % 5) AS resolved_by, CAST(ts AS TIMESTAMP) + INTERVAL '2' DAY AS requested_at
FROM {events}
"""

# Raw messages: START, RUNNING and end events of every order's run (some reversed, repeated, late or
# broken), and a check event of every row of events. A dataset is written with its port and as postgres.
MESSAGES = """
SELECT batch_id, arrival, ingested_at,
  CASE WHEN broken = 1 THEN substr(value, 1, 70) WHEN broken = 2 THEN replace(value, '"eventType"', '"kind"') ELSE value END AS value
FROM (
  SELECT CASE WHEN slot = 5 THEN -1000000000000 - k WHEN k % 2 = 0 THEN k ELSE -1 - CAST(floor(k / 8) AS BIGINT) END AS batch_id,
    k * 8 + CASE WHEN k % 5 = 0 AND slot < 3 THEN 2 - slot ELSE slot END AS arrival,
    CASE WHEN slot = 5 THEN t0 + INTERVAL '50' HOUR ELSE t0 + INTERVAL '24' HOUR END AS ingested_at,
    CASE WHEN k % 43 = 10 THEN 1 WHEN k % 47 = 11 THEN 2 ELSE 0 END AS broken,
    concat('{{"eventTime":"',
      CASE WHEN k % 29 = 6 THEN 'not-a-time'
        WHEN k % 4 = 0 THEN concat(replace(CAST(tm AS STRING), ' ', 'T'), 'Z')
        WHEN k % 4 = 1 THEN replace(CAST(tm AS STRING), ' ', 'T')
        WHEN k % 4 = 2 THEN concat(replace(CAST(tm AS STRING), ' ', 'T'), '+00:00')
        ELSE concat(replace(CAST(tm + INTERVAL '2' HOUR AS STRING), ' ', 'T'), '.250+02:00') END,
      '","eventType":"', CASE WHEN k % 23 = 5 THEN 'FINISHED' WHEN k % 7 = 3 THEN concat(' ', kind, ' ') ELSE kind END,
      '","producer":"', CASE WHEN k % 19 = 4 THEN ''
        WHEN k % 3 = 0 THEN 'https://github.com/apache/airflow/tree/providers-openlineage/2.10.0'
        WHEN k % 3 = 1 THEN concat('https://github.com/dbt-labs/dbt-core/tree/1.5.', slot)
        WHEN k % 6 = 2 THEN 'https://github.com/OpenLineage/OpenLineage/tree/1.0.0/integration/spark'
        ELSE 'https://tools.example.org/spark' END,
      '","schemaURL":"', CASE WHEN k % 31 = 7 THEN 'https://example.com/schema.json' WHEN k % 2 = 0
        THEN 'https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent'
        ELSE 'https://openlineage.io/spec/1-8-0/OpenLineage.json' END,
      '","run":{{"runId":"', CASE WHEN k % 37 = 8 THEN '  ' ELSE concat('r', k) END, '"',
      CASE WHEN k % 61 = 0 THEN '' ELSE concat(',"facets":{{',
        CASE WHEN k = 0 THEN '' WHEN k % 53 = 1 THEN '"parent":"none"' WHEN k % 59 = 1 THEN '"parent":{{"run":{{"runId":12}}}}'
          ELSE concat('"parent":{{"run":{{"runId":"r', CAST(floor(k / 4) AS BIGINT), '"}}',
            CASE WHEN k >= 64 THEN concat(',"root":{{"run":{{"runId":"r', CAST(floor(k / 64) AS BIGINT), '"}}}}') ELSE '' END, '}}') END,
        '}}') END,
      '}},"job":{{"namespace":"', CASE WHEN k % 41 = 9 THEN '' ELSE concat(' ns', k % 3) END, '","name":"job_', c % 40, '"}}',
      ',"inputs":[', CASE WHEN k > 0 THEN concat(
        '{{"namespace":"postgres://wh:5432","name":"analytics.s', CAST(floor(k / 3) AS BIGINT) % 5, '.t', CAST(floor(k / 3) AS BIGINT),
        '","facets":{{"schema":{{"read":', k, '}}}},"inputFacets":{{"metrics":{{"rowCount":', slot, '}}}}}}') ELSE '' END,
      CASE WHEN k % 7 = 0 AND k > 3 THEN concat(
        ',{{"namespace":"postgresql://wh","name":"analytics.s', (CAST(floor(k / 3) AS BIGINT) + 1) % 5, '.t', CAST(floor(k / 3) AS BIGINT) + 1, '"}}')
        ELSE '' END,
      ']', CASE WHEN slot < 2 THEN '' ELSE concat(',"outputs":[',
        '{{"namespace":" Postgres://wh:5432","name":"analytics.s', k % 5, '.t', k, '","facets":{{"schema":{{"made":', k,
        '}}}},"outputFacets":{{"stats":{{"rowCount":', k + slot, '}}}}}}',
        CASE WHEN k % 11 = 0 AND k > 0 THEN concat(',{{"namespace":"postgres://wh","name":"analytics.s', (k - 1) % 5, '.t', k - 1,
          '","facets":null}}') ELSE '' END, ']') END, '}}') AS value
  FROM (
    SELECT k, c, t0, 0 AS slot, 'START' AS kind, t0 AS tm FROM {runs}
    UNION ALL SELECT k, c, t0, 1, 'RUNNING', t0 + INTERVAL '30' MINUTE FROM {runs} WHERE k % 2 = 0
    UNION ALL SELECT k, c, t0, 2, st, t0 + INTERVAL '1' HOUR FROM {runs}
    UNION ALL SELECT k, c, t0, 3, st, t0 + INTERVAL '1' HOUR FROM {runs} WHERE k % 13 = 0
    UNION ALL SELECT k, c, t0, 4, 'START', t0 + INTERVAL '2' HOUR FROM {runs} WHERE k % 17 = 0
    UNION ALL SELECT k, c, t0, 5, st, t0 + INTERVAL '1' HOUR FROM {runs} WHERE k % 97 = 0
  ) s
  UNION ALL
  SELECT 2000000000000 + e, 4000000000000 + e * 8 + slot, ts + INTERVAL '1' HOUR, 0,
    concat('{{"eventTime":"', replace(CAST(tm AS STRING), ' ', 'T'), 'Z","eventType":"', kind,
      '","producer":"https://github.com/OpenLineage/OpenLineage/tree/1.0.0/integration/common/openlineage/provider/great_expectations',
      '","schemaURL":"https://openlineage.io/spec/2-0-2/OpenLineage.json","run":{{"runId":"q', e,
      '","facets":{{"parent":{{"run":{{"runId":"r', e, '"}},"root":{{"run":{{"runId":"r', CAST(floor(e / 64) AS BIGINT), '"}}}}}}}}}}',
      ',"job":{{"namespace":"checks","name":"check_', h % 2, '"}},"inputs":[{{"namespace":"',
      CASE WHEN dk % 10 = 9 THEN 'demo_wh' ELSE 'postgres://wh:5432' END, '","name":"',
      CASE WHEN dk % 10 <> 9 AND dk % 3 = 0 THEN '' ELSE 'analytics.' END, 's', dk % 5, '.t', dk,
      '","inputFacets":{{"dataQualityAssertions":{{"assertions":',
      CASE event_type
        WHEN 'click' THEN concat('[{{"assertion":"test_', h % 2, '","success":', CASE WHEN slot = 0 THEN 'false' ELSE 'true' END, ',"column":"c"}}]')
        WHEN 'purchase' THEN concat('[{{"assertion":"test_', h % 2, '","success":false,"column":"c","severity":"error"}}]')
        WHEN 'error' THEN concat('[{{"assertion":"test_', h % 2, '","success":"true"}}]')
        WHEN 'view' THEN concat('[5,{{"success":true}},{{"assertion":7,"success":true}},{{"assertion":"test_', h % 2, '","severity":"low"}}]')
        ELSE '"none"' END, '}}',
      CASE WHEN e % 5 = 0 THEN ',"greatExpectations_assertions":{{"assertions":[{{"expectationType":"expect_rows","success":true}}]}}' ELSE '' END,
      '}}}}],"outputs":[]}}')
  FROM (
    SELECT e, h, dk, event_type, ts, 0 AS slot, 'START' AS kind, ts AS tm FROM {checks} WHERE e % 10 = 0
    UNION ALL SELECT e, h, dk, event_type, ts, 1, 'COMPLETE', ts + INTERVAL '1' MINUTE FROM {checks}
  ) v
) m
"""

# Names as tools write them, with every shape the name rules tell apart.
NAMES = """
SELECT k,
  concat(CASE k % 10 WHEN 0 THEN 'postgres://wh:5432' WHEN 1 THEN 'PostgreSQL://HOST' WHEN 2 THEN 's3a://Bucket/Path/To'
    WHEN 3 THEN 'mysql://db:3307' WHEN 4 THEN 'postgres://user:pw@db:5432' WHEN 5 THEN 'postgres://db:5432/my'
    WHEN 6 THEN 'S3N://db:54?x=' WHEN 7 THEN 'bigquery' WHEN 8 THEN 'kafka://b1:9092,b2:9092' ELSE 'a:b/c' END,
    CASE WHEN k % 3 = 0 THEN '' ELSE concat('.', c) END) AS namespace,
  CASE k % 7 WHEN 0 THEN concat('Analytics.Public.t', k) WHEN 1 THEN concat('/file', k, '.csv') WHEN 2 THEN ''
    WHEN 3 THEN concat('a/b/c', k, '.PARQUET') WHEN 4 THEN '/' WHEN 5 THEN concat('user-events', k) ELSE concat('x.y.', k, '.json') END AS name,
  CASE k % 8 WHEN 0 THEN concat('demo_pg/Customers', k) WHEN 1 THEN concat('postgresql://host/db.public.o', k)
    WHEN 2 THEN concat(' s3://bucket//data/c', k, '.Parquet ') WHEN 3 THEN concat('postgresql://wh/s', k % 5, '.t', k)
    WHEN 4 THEN concat('plain', k) WHEN 5 THEN concat('/t', k) WHEN 6 THEN concat('ns', k, '//') ELSE concat('ns', k, '/') END AS urn,
  CASE k % 9 WHEN 0 THEN concat('https://github.com/dbt-labs/dbt-core/tree/1.', k % 7, '.0') WHEN 1 THEN ''
    WHEN 2 THEN 'https://github.com/apache/airflow/tree/providers-openlineage/2.10.0'
    WHEN 3 THEN 'https://github.com/OpenLineage/OpenLineage/tree/1.0.0/integration/spark'
    WHEN 4 THEN 'https://github.com/OpenLineage/OpenLineage/tree/$VERSION/integration/common/openlineage/provider/great_expectations'
    WHEN 5 THEN concat('http://github.com/some/plugin-', c, '/v0.', k % 5) WHEN 6 THEN 'https://github.com/short'
    WHEN 7 THEN concat('tools.example.org/p', c) ELSE 'https://github.com/org/repo/tree' END AS producer,
  CASE k % 6 WHEN 0 THEN 'https://openlineage.io/spec/2-0-2/OpenLineage.json' WHEN 1 THEN concat('https://openlineage.io/spec/1-', k % 9, '-0/OpenLineage.json#/$defs/RunEvent')
    WHEN 2 THEN 'https://example.com/schema.json' WHEN 3 THEN 'https://openlineage.io/spec/' WHEN 4 THEN 'https://openlineage.io/spec/garbage'
    ELSE 'https://openlineage.io/spec/2-0-2/OpenLineage.json/x' END AS schema_url
FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o
"""

# Test results as a caller might hand them in, some breaking a rule.
GIVEN_RESULTS = """
SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN repeat('xy', 400) ELSE concat('t', event_id % 5) END AS test_name,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'nocolon/t' ELSE concat('a://b/t', user_id) END AS dataset_urn,
  CASE WHEN event_id % 23 = 0 THEN ' ' ELSE concat('r', event_id) END AS run_id,
  CASE event_type WHEN 'signup' THEN 'unknown' WHEN 'click' THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN event_id % 29 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END AS executed_at,
  CAST(event_id % 31 AS INT) - 1 AS duration_ms
FROM {events}
"""

# The demo warehouse: customers and orders under the column names of its seed files.
RAW_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name FROM {customer}"
RAW_ORDERS = """
SELECT id, customer, ordered_at, store_id, CAST(floor(order_total / 2) AS BIGINT) AS subtotal,
  order_total - CAST(floor(order_total / 2) AS BIGINT) AS tax_paid, order_total
FROM (SELECT o_orderkey AS id, o_custkey AS customer, CAST(o_orderdate AS TIMESTAMP) AS ordered_at, o_orderpriority AS store_id,
        CAST(round(o_totalprice * 100) AS BIGINT) AS order_total FROM {orders}) o
"""

_MESSAGE_RUNS = """(SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) AS t0,
  CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'COMPLETE' ELSE 'OTHER' END AS st FROM {orders})"""
_MESSAGE_CHECKS = """(SELECT event_id AS e, CAST(floor(event_id / 2) AS BIGINT) AS h, CAST(floor(event_id / 4) AS BIGINT) AS dk,
  event_type, CAST(ts AS TIMESTAMP) AS ts FROM {events})"""


def message_text() -> str:
    """The text of MESSAGES with its two sources filled in; braces of JSON become plain."""
    runs, checks = _MESSAGE_RUNS.replace("{orders}", "{{orders}}"), _MESSAGE_CHECKS.replace("{events}", "{{events}}")
    return MESSAGES.format(runs=runs.replace("{{", "{").replace("}}", "}"), checks=checks.replace("{{", "{").replace("}}", "}"))


TEXTS = {
    "runs": RUNS,
    "datasets": DATASETS,
    "edges": EDGES,
    "tests": TESTS,
    "resolutions": RESOLUTIONS,
    "requests": REQUESTS,
    "messages": message_text(),
    "names": NAMES,
    "given_results": GIVEN_RESULTS,
    "raw_customers": RAW_CUSTOMERS,
    "raw_orders": RAW_ORDERS,
}

_SOURCES = ("orders", "events", "customer")


def plain_text(name: str) -> str:
    """A text over the table names as they are."""
    text = TEXTS[name]
    for source in _SOURCES:
        text = text.replace("{" + source + "}", source)
    return text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the derived tables, read from the given ones."""
    text = TEXTS[name]
    for source in _SOURCES:
        if "{" + source + "}" in text:
            table(spark, folder, source).createOrReplaceTempView(f"given_{source}")
            text = text.replace("{" + source + "}", f"given_{source}")
    return spark.sql(text)


def lineage_tables(spark: SparkSession, folder: str) -> Tables:
    tune(spark)
    return Tables(
        runs=derived(spark, folder, "runs"),
        datasets=derived(spark, folder, "datasets"),
        edges=derived(spark, folder, "edges"),
        tests=derived(spark, folder, "tests"),
        resolutions=derived(spark, folder, "resolutions"),
        aliases=AliasResolver(ALIAS_RULES),
    )
