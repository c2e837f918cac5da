"""Names, event fields, rules over single rows, and the demo warehouse."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from causeway.functions import event_fields as ef, urn as names
from causeway.functions.aliases import AliasResolver, RuleIndex
from causeway.operators import validation
from causeway.plans import quality
from causeway.sources import alias_file, events as event_source, seeds
from causeway.workload import given
from causeway.workload.lines import line_sql, lines, union
from causeway.workload.registry import Given, query
from causeway.workload import sql


@query("a8_alias_rules", "SELECT run_id, dataset_urn, edge_type, " + sql.canonical("dataset_urn") + " AS canonical_urn FROM edges "
       "UNION ALL SELECT run_id, dataset_urn, 'test', " + sql.canonical("dataset_urn") + " FROM tests")
def alias_rules(g: Given):
    """Rules as configuration text, applied to every URN the tables mention."""
    entries = [{"pattern": pattern, "canonical": canonical} for pattern, canonical in given.ALIAS_RULES]
    resolver = AliasResolver(alias_file.parse_alias_rules(json.dumps({"dataset_patterns": entries})))
    edges = g["edges"].select("run_id", "dataset_urn", "edge_type")
    tests = g["tests"].select("run_id", "dataset_urn", F.lit("test").alias("edge_type"))
    return edges.union(tests).withColumn("canonical_urn", resolver.resolve(F.col("dataset_urn")))


_SEEDS = {"customers": ("id", "name"), "orders": ("id", "customer", "@ordered_at", "store_id", "subtotal", "tax_paid", "order_total")}


@query("a9_seed_files", " UNION ALL ".join(line_sql(name, f"raw_{name}", *columns) for name, columns in _SEEDS.items()))
def seed_files(g: Given):
    """Both seeds as files with a header, read back under their fixed schemas."""
    read = {"customers": seeds.read_customers, "orders": seeds.read_orders}
    found = []
    for name, columns in _SEEDS.items():
        path = f"{g.scratch.root}/seed_{name}"
        g[f"raw_{name}"].write.option("header", True).csv(path)
        found.append(lines(read[name](g.spark, path), name, *columns))
    return union(found)


_TIMES = """SELECT arrival, event_time, event_time_text FROM ev"""


@query("b1_event_time", _TIMES)
def event_time(g: Given):
    return g.heads.select("arrival", "event_time", "event_time_text")


@query("b2_namespace", f"SELECT k, {sql.normalized('namespace')} AS namespace FROM names")
def namespaces(g: Given):
    return g["names"].select("k", names.normalize_namespace(F.col("namespace")).alias("namespace"))


@query("b3_dataset_urn", f"SELECT k, concat({sql.normalized('namespace')}, '/', name) AS urn FROM names")
def dataset_urns(g: Given):
    return g["names"].select("k", names.dataset_urn(F.col("namespace"), F.col("name")).alias("urn"))


@query("b4_parse_urn", f"SELECT k, {sql.parsed_urn('urn')} FROM (SELECT k, urn FROM names) n")
def parse_urns(g: Given):
    return g["names"].select("k", names.parse_urn(F.col("urn")).alias("p")).select("k", "p.*")


@query("b5_normalize_urn", f"SELECT k, CASE WHEN error IS NULL THEN u END AS urn, error FROM "
       f"(SELECT k, u, {sql.parsed_urn('u')} FROM (SELECT k, trim(urn) AS u FROM names) n) x")
def normalize_urns(g: Given):
    return g["names"].select("k", names.normalize_urn(F.col("urn")).alias("p")).select("k", "p.*")


@query("b6_table_name", f"SELECT k, {sql.table_name('urn')} AS table_name, {sql.table_name('long_urn')} AS long_table_name FROM "
       "(SELECT k, urn, concat(namespace, '/', name) AS long_urn FROM names) n")
def table_names(g: Given):
    long_urn = F.concat("namespace", F.lit("/"), "name")
    return g["names"].select(
        "k", names.table_name(F.col("urn")).alias("table_name"), names.table_name(long_urn).alias("long_table_name")
    )


@query("b7_compiled_rules", r"""SELECT k, CASE WHEN regexp_matches(urn, '^postgresql://wh/s[^/]+\.[^/]+$') THEN 1
  WHEN regexp_matches(urn, '^demo_pg/.+$') THEN 2 ELSE 0 END AS rule_no FROM names""")
def compiled_rules(g: Given):
    resolver = AliasResolver([("", "x"), ("{a}/{a}", "y"), *given.ALIAS_RULES, ("demo_pg/{path*}", "postgresql://pg/{path}")])
    number = F.lit(0)
    for position, rule in reversed(list(enumerate(resolver.rules, 1))):
        number = F.when(rule.matches(F.col("urn")), F.lit(position)).otherwise(number)
    return g["names"].select("k", number.alias("rule_no"))


_TWO_RULES = r"""CASE WHEN regexp_matches(urn, '^postgresql://wh/s[^/]+\.[^/]+$') THEN
  regexp_replace(urn, '^postgresql://wh/s([^/]+)\.([^/]+)$', 'postgresql://wh/analytics.s\1.\2')
  WHEN regexp_matches(urn, '^demo_pg/.+$') THEN regexp_replace(urn, '^demo_pg/(.+)$', 'postgresql://pg/\1') END"""


_RULES = [*given.ALIAS_RULES, ("demo_pg/{path*}", "postgresql://pg/{path}"), ("demo_pg/{x}", "never")]


def _two_rules():
    return AliasResolver(_RULES)


@query("b8_resolve", f"SELECT k, coalesce({_TWO_RULES}, urn) AS canonical_urn FROM names")
def resolve(g: Given):
    """By the index over rules; the chain of conditions is asked by ``b9_match``."""
    return RuleIndex(g.spark, _RULES).resolve(g["names"].select("k", "urn")).select("k", "canonical_urn")


@query("b9_match", f"SELECT k, {_TWO_RULES} AS canonical_urn, {_TWO_RULES} IS NOT NULL AS matched FROM names")
def match(g: Given):
    found = _two_rules().match(F.col("urn"))
    return g["names"].select("k", found.alias("canonical_urn"), found.isNotNull().alias("matched"))


@query("b10_event_key", "SELECT arrival, idempotency_key FROM ev")
def event_key(g: Given):
    return g.heads.select("arrival", "idempotency_key")


@query("b11_producer_name", f"SELECT k, {sql.producer_name('producer')} AS producer_name FROM names")
def producer_names(g: Given):
    return g["names"].select("k", ef.producer_name(F.col("producer")).alias("producer_name"))


@query("b12_producer_version", f"SELECT k, {sql.producer_version('producer')} AS producer_version FROM names")
def producer_versions(g: Given):
    return g["names"].select("k", ef.producer_version(F.col("producer")).alias("producer_version"))


_SPEC = r"regexp_matches(split_part(schema_url, '#', 1), '^https://openlineage\.io/spec/\d+-\d+-\d+/OpenLineage\.json$')"


@query("b13_spec_url", f"SELECT k, {_SPEC} AS is_spec FROM names")
def spec_urls(g: Given):
    return g["names"].select("k", ef.is_spec_url(F.col("schema_url")).alias("is_spec"))


@query("b14_spec_version", f"SELECT k, CASE WHEN {_SPEC} THEN replace(split_part(schema_url, '/', 5), '-', '.') ELSE '' END AS version FROM names")
def spec_versions(g: Given):
    return g["names"].select("k", ef.spec_version(F.col("schema_url")).alias("version"))


@query("b15_parents", "SELECT arrival, parent_id, root_id FROM ev")
def parents(g: Given):
    return g.events.select(
        "arrival", ef.parent_run_id(F.col("run_facets")).alias("parent_id"),
        ef.root_parent_run_id(F.col("run_facets")).alias("root_id"),
    )


@query("b17_run_metadata", """SELECT arrival, producer, schema_url,
  coalesce(len(json_keys(CASE WHEN json_type(j, '$.run.facets') = 'OBJECT' THEN j->'$.run.facets' END)), 0) AS run_facets,
  coalesce(j->>'$.run.facets.parent', '') AS parent_facet FROM ev""")
def run_metadata(g: Given):
    meta = ef.run_metadata(F.col("job_facets"), F.col("run_facets"), F.col("producer"), F.col("schema_url"))
    return g.events.select("arrival", meta.alias("m")).select(
        "arrival", "m.producer", "m.schema_url", F.size("m.run_facets").cast("bigint").alias("run_facets"),
        F.coalesce(F.try_element_at("m.run_facets", F.lit("parent")), F.lit("")).alias("parent_facet"),
    )


@query("b18_effective_status", f"""SELECT c.run_id,
  CASE WHEN c.current_state IN ('RUNNING','START','OTHER','') AND p.current_state IN {sql.TERMINAL} THEN p.current_state ELSE c.current_state END AS status,
  CASE WHEN c.current_state IN ('RUNNING','START','OTHER','') AND p.current_state IN {sql.TERMINAL} THEN p.completed_at ELSE c.completed_at END AS completed_at
  FROM runs c LEFT JOIN runs p ON c.parent_run_id = p.run_id""")
def effective_status(g: Given):
    runs = g["runs"]
    parent = runs.select(
        F.col("run_id").alias("parent_run_id"), F.col("current_state").alias("p_state"), F.col("completed_at").alias("p_done")
    )
    joined = runs.join(parent, "parent_run_id", "left")
    own = F.col("current_state")
    return joined.select(
        "run_id",
        ef.effective_job_status(own, F.col("p_state")).alias("status"),
        ef.effective_completed_at(own, F.col("p_state"), F.col("completed_at"), F.col("p_done")).alias("completed_at"),
    )


@query("b22_display_name", r"""SELECT k, coalesce(nullif(regexp_extract(urn, '/([^/]+\.[^/]+)$', 1), ''),
  list_last(list_filter(string_split(urn, '/'), lambda p: p <> '')), urn) AS display_name FROM names""")
def display_names(g: Given):
    return g["names"].select("k", names.display_name(F.col("urn")).alias("display_name"))


@query("b16_flat_facets", """SELECT arrival, p - 1 - (CASE WHEN p > 1000 THEN 1000 ELSE 0 END) + (CASE WHEN p > 1000 THEN n_out ELSE 0 END) AS position,
  facet, value FROM (SELECT f.*, (SELECT count(*) FROM dsets d WHERE d.arrival = f.arrival AND d.edge_type = 'output') AS n_out FROM facet_rows f) x""")
def flat_facets(g: Given):
    from causeway.operators import tables

    entries = tables.facet_entries(g.events).select("arrival", F.col("position").cast("bigint").alias("position"), "facet", "value")
    return g.ingested.keep(entries)


@query("b20_assertion_status", "SELECT run_id, arrival, test_name, status FROM tests_named")
def assertion_status(g: Given):
    from causeway.operators import tables

    return g.ingested.keep(tables.extract_tests(g.asserting).select("run_id", "arrival", "test_name", "status"))


@query("c1_validate_events", f"SELECT arrival, run_id, {sql.REASON} AS reject_reason FROM ev")
def validate_events(g: Given):
    return validation.validate_events(g.heads).select("arrival", "run_id", "reject_reason")


@query("c2_validate_datasets", f"""SELECT run_id, arrival, edge_type, namespace, name, CASE WHEN namespace = '' THEN 'dataset_missing_namespace'
  WHEN name = '' THEN 'dataset_missing_name' END AS reject_reason FROM (SELECT run_id, arrival, edge_type,
    {sql.normalized("trim(d->>'$.namespace')")} AS namespace, trim(d->>'$.name') AS name FROM (
    SELECT run_id, arrival, 'output' AS edge_type, unnest(CAST(j->'$.outputs' AS JSON[])) AS d FROM ev
    UNION ALL SELECT run_id, arrival, 'input', unnest(CAST(j->'$.inputs' AS JSON[])) FROM ev) x) y""")
def validate_datasets(g: Given):
    return validation.validate_datasets(g.events).drop("position")


@query("c3_validate_tests", """SELECT id, CASE WHEN trim(test_name) = '' THEN 'test_name_empty' WHEN strlen(test_name) > 750 THEN 'test_name_too_long'
  WHEN trim(dataset_urn) = '' THEN 'dataset_urn_empty' WHEN strpos(dataset_urn, ':') = 0 THEN 'dataset_urn_invalid'
  WHEN trim(run_id) = '' THEN 'run_id_empty' WHEN status NOT IN ('passed','failed','error','skipped','warning') THEN 'status_invalid'
  WHEN executed_at IS NULL THEN 'executed_at_zero' WHEN duration_ms < 0 THEN 'duration_ms_negative' END AS reject_reason FROM given_results""")
def validate_tests(g: Given):
    return validation.validate_test_results(g["given_results"]).select("id", "reject_reason")


@query("c4_transitions", f"""SELECT run_id, arrival, before, event_type, {sql.transition('before', 'event_type')} AS problem FROM
  (SELECT run_id, arrival, event_type, lag(event_type) OVER (PARTITION BY run_id ORDER BY arrival) AS before FROM ev) x""")
def transitions(g: Given):
    from causeway.operators.ordered import arrival_block, with_previous

    # Written, as the step back reads it twice and messages are dear to parse.
    slim = g.scratch.cut(g.heads.select("run_id", "arrival", "event_type"))
    steps = with_previous(slim, ["run_id"], ["arrival"], arrival_block(F.col("arrival")), F.col("event_type"), "before")
    return steps.withColumn("problem", validation.transition_error(F.col("before"), F.col("event_type")))


@query("c5_sequences", "SELECT batch_id, run_id, event_count, first_arrival, sequence_error, final_state FROM verdicts")
def sequences(g: Given):
    return validation.sequence_errors(g.scratch.cut(g.heads.select("batch_id", "run_id", "arrival", "event_type", "event_time")), g.scratch)


@query("n1_staging", "SELECT 'customer' AS kind, id AS row_id, id AS customer_id, name AS label FROM raw_customers "
       "UNION ALL SELECT 'order', id, customer, store_id FROM raw_orders")
def staging(g: Given):
    customers = quality.stage_customers(g["raw_customers"])
    orders = quality.stage_orders(g["raw_orders"])
    return customers.select(
        F.lit("customer").alias("kind"), F.col("customer_id").alias("row_id"), "customer_id", F.col("customer_name").alias("label")
    ).unionByName(
        orders.select(F.lit("order").alias("kind"), F.col("order_id").alias("row_id"), "customer_id", F.col("store_id").alias("label"))
    )


def _marts(g: Given):
    customers = quality.stage_customers(g["raw_customers"])
    orders = quality.orders_mart(quality.stage_orders(g["raw_orders"]), customers)
    return customers, orders


_ORDERS_MART = """SELECT o.id AS order_id, o.customer AS customer_id, c.name AS customer_name, o.ordered_at, o.store_id,
  o.subtotal, o.tax_paid, o.order_total FROM raw_orders o LEFT JOIN raw_customers c ON o.customer = c.id"""


@query("n2_orders_mart", _ORDERS_MART)
def orders_mart(g: Given):
    return _marts(g)[1]


_CUSTOMERS_MART = """SELECT c.id AS customer_id, c.name AS customer_name, coalesce(o.order_count, 0) AS order_count,
  coalesce(o.total_amount, 0) AS total_amount, o.first_order_at, o.last_order_at FROM raw_customers c LEFT JOIN
  (SELECT customer, count(*) AS order_count, CAST(sum(order_total) AS BIGINT) AS total_amount, min(ordered_at) AS first_order_at,
     max(ordered_at) AS last_order_at FROM raw_orders GROUP BY customer) o ON c.id = o.customer"""


@query("n3_customers_mart", _CUSTOMERS_MART)
def customers_mart(g: Given):
    return quality.customers_mart(*_marts(g))


@query("e9_customer_totals", """SELECT customer AS customer_id, count(*) AS order_count, CAST(sum(order_total) AS BIGINT) AS total_amount,
  min(ordered_at) AS first_order_at, max(ordered_at) AS last_order_at FROM raw_orders GROUP BY customer""")
def customer_totals(g: Given):
    return quality.customer_orders(_marts(g)[1])


@query("d14_demo_joins", f"""SELECT m.customer_id, m.order_count, count(o.order_id) AS joined_orders FROM ({_CUSTOMERS_MART}) m
  LEFT JOIN ({_ORDERS_MART}) o ON m.customer_id = o.customer_id GROUP BY m.customer_id, m.order_count""")
def demo_joins(g: Given):
    customers, orders = _marts(g)
    mart = quality.customers_mart(customers, orders).select("customer_id", "order_count")
    counted = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("joined_orders"))
    return mart.join(counted, "customer_id", "left").withColumn(
        "joined_orders", F.coalesce("joined_orders", F.lit(0).cast("bigint"))
    )


@query("n4_column_checks", f"""SELECT 'not_null' AS check_name, 'order_id' AS column_name, count(*) FILTER (WHERE id IS NULL) AS failures FROM raw_orders
  UNION ALL SELECT 'not_null', 'customer_name', count(*) FILTER (WHERE customer_name IS NULL) FROM ({_ORDERS_MART}) a
  UNION ALL SELECT 'not_null', 'order_total', count(*) FILTER (WHERE order_total IS NULL) FROM raw_orders
  UNION ALL SELECT 'unique', 'order_id', count(*) FROM (SELECT id FROM raw_orders GROUP BY id HAVING count(*) > 1) u
  UNION ALL SELECT 'unique', 'customer_id', count(*) FROM (SELECT customer FROM raw_orders GROUP BY customer HAVING count(*) > 1) v
  UNION ALL SELECT 'relationships', 'customer_id', count(*) FROM raw_orders WHERE customer NOT IN (SELECT id FROM raw_customers)""")
def column_checks(g: Given):
    customers, orders = _marts(g)
    own = quality.column_checks(orders, unique=["order_id", "customer_id"], not_null=["order_id", "customer_name", "order_total"])
    return own.unionByName(quality.relationship_check(orders, "customer_id", customers, "customer_id"))


def _expected(suite, table: str, sources: str) -> str:
    rows = []
    for kind, column, low, high in suite:
        if kind.startswith("expect_table_row"):
            test = f"(SELECT count(*) BETWEEN {low} AND {high} FROM {table})"
        elif kind == "expect_column_to_exist":
            test = "true"
        elif kind.endswith("unique"):
            test = f"(SELECT count({column}) = count(DISTINCT {column}) FROM {table})"
        elif kind.endswith("not_be_null"):
            test = f"(SELECT count(*) = count({column}) FROM {table})"
        else:
            test = f"(SELECT count(*) FILTER (WHERE {column} < {low}) = 0 FROM {table})"
        rows.append(
            f"SELECT '{kind}' AS test_name, '{column or ''}' AS column_name, CASE WHEN {test} THEN 'passed' ELSE 'failed' END AS status"
        )
    return f"SELECT * FROM (WITH {table} AS ({sources}) " + " UNION ALL ".join(rows) + ") q"


@query("n5_expectations", "SELECT 'customers' AS suite, * FROM (" + _expected(quality.CUSTOMER_SUITE, "cm", _CUSTOMERS_MART) + ") a UNION ALL "
       "SELECT 'orders', * FROM (" + _expected(quality.ORDER_SUITE, "om", _ORDERS_MART) + ") b")
def expectations(g: Given):
    customers, orders = _marts(g)
    mart = quality.customers_mart(customers, orders)
    return (
        quality.run_expectations(mart, quality.CUSTOMER_SUITE).withColumn("suite", F.lit("customers"))
        .unionByName(quality.run_expectations(orders, quality.ORDER_SUITE).withColumn("suite", F.lit("orders")))
    )


@query("a1_read_batches", """SELECT floor(arrival / 4096)::BIGINT AS part, row_number() OVER (PARTITION BY floor(arrival / 4096) ORDER BY arrival) - 1 AS place,
  tt AS event_time, j->>'$.eventType' AS event_type, j->>'$.run.runId' AS run_id FROM ev0""")
def read_batches(g: Given):
    """Events written as files of one JSON array each, beside one broken and one empty file, and read back."""
    path = f"{g.scratch.root}/requests"
    valid = event_source.keep_run_events(g["messages"]).withColumn("part", F.floor(F.col("arrival") / 4096))
    arrays = valid.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("arrival", "value"))).alias("m")).select(
        "part", F.concat(F.lit("["), F.array_join("m.value", ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").option("compression", "gzip").text(path)
    broken = g.spark.createDataFrame([(-1, "[{broken"), (-2, "[]")], "part long, value string")
    broken.write.mode("append").partitionBy("part").text(path)
    events, _ = event_source.read_event_batch(g.spark, path, g.scratch)
    # A partition of the path is one file here; the place in it is in the lower bits' stead of a partition.
    part = F.regexp_extract("source_file", "part=(-?[0-9]+)", 1).cast("bigint")
    return events.select(part.alias("part"), F.col("arrival").bitwiseAND(F.lit((1 << 20) - 1)).alias("place"),
                         F.col("eventTime").alias("event_time"), F.col("eventType").alias("event_type"), F.col("run.runId").alias("run_id"))


@query("a3_run_events", "SELECT batch_id, arrival FROM probe")
def run_events(g: Given):
    return event_source.keep_run_events(g["messages"]).select("batch_id", "arrival")


# One row per named dataset of each event, in one pass over the texts.
_MENTIONED = f"""SELECT arrival, event_type, run_id, job_namespace, job_name, producer, kind, {sql.normalized('ns')} AS namespace, name,
  facets FROM (SELECT *, trim(coalesce(d->>'$.namespace', '')) AS ns, trim(coalesce(d->>'$.name', '')) AS name,
    coalesce(len(json_keys(d, '$.facets')), 0) AS facets FROM (SELECT * EXCLUDE (part), part.kind AS kind, unnest(part.items) AS d FROM (
      SELECT arrival, event_type, run_id, job_namespace, job_name, producer,
        unnest([{{'kind': 'output', 'items': CAST(j->'$.outputs' AS JSON[])}}, {{'kind': 'input', 'items': CAST(j->'$.inputs' AS JSON[])}}]) AS part
      FROM ev) a) b) c"""


@query("a4_normalize", f"SELECT * EXCLUDE (namespace, name), namespace, name, concat(namespace, '/', name) AS urn FROM ({_MENTIONED}) q "
       "WHERE namespace <> '' AND name <> ''")
def normalize(g: Given):
    """Every named dataset of every event, as it is stored."""
    def kinds(name: str, kind: str):
        return F.transform(name, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("d")))

    rows = g.events.select(
        "arrival", "event_type", "run_id", "job_namespace", "job_name", "producer",
        F.explode(F.concat(kinds("outputs", "output"), kinds("inputs", "input"))).alias("m"))
    return rows.filter("m.d.namespace <> '' AND m.d.name <> ''").select(
        "arrival", "event_type", "run_id", "job_namespace", "job_name", "producer", "m.kind", "m.d.namespace", "m.d.name", "m.d.urn",
        F.size("m.d.facets").cast("bigint").alias("facets"))


@query("a5_split", "SELECT batch_id, arrival, run_id, reject_reason AS reason, false AS retriable FROM checked WHERE reject_reason IS NOT NULL "
       "UNION ALL SELECT batch_id, arrival, run_id, NULL, NULL FROM checked WHERE reject_reason IS NULL")
def split(g: Given):
    good, bad = validation.split_events(validation.validate_batches(g.events, g.scratch))
    kept = good.select("batch_id", "arrival", "run_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("boolean").alias("retriable"))
    return bad.unionByName(kept)
