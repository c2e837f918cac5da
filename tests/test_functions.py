import pytest
from pyspark.sql import functions as F

from causeway.functions import event_fields as ef, urn
from causeway.functions.aliases import AliasResolver
from causeway.sources import alias_file, events


def one_by_one(spark, cases, function):
    """Apply a column function to the first item of each case."""
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    rows = frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in rows]


def check(spark, cases, function):
    assert one_by_one(spark, cases, function) == [expected for _, expected in cases]


def test_namespace(spark):
    check(spark, [
        ("postgres://prod-db:5432", "postgresql://prod-db"), ("PostgreSQL://HOST", "postgresql://HOST"),
        ("s3a://MyBucket/Path/To/File", "s3://MyBucket/Path/To/File"), ("mysql://db:3307", "mysql://db"),
        ("postgres://user:***@db:5432", "postgresql://user:***@db"), ("postgres://db:5432/mydb", "postgresql://db/mydb"),
        ("postgres://db:5432?sslmode=require", "postgresql://db?sslmode=require"), ("bigquery", "bigquery"),
        ("kafka://b1:9092,b2:9092", "kafka://b1:9092,b2"), ("x://a:1/x@db", "x://a:1/x@db"), ("", ""), ("://a:1", "://a"),
    ], urn.normalize_namespace)


def test_table_name(spark):
    check(spark, [
        ("demo_postgres/customers", "customers"), ("postgresql://host/mydb.public.orders", "orders"),
        ("s3://bucket/data/customers.parquet", "customers"), ("kafka://cluster/topic.events", "events"),
        ("kafka://cluster/user-events", "user-events"), ("schema.subschema.table", "table"),
        ("postgresql://demo/marts.CustomerOrders", "customerorders"), ("", ""), ("s3://b/a.b.CSV", "b"),
    ], urn.table_name)


def test_parse_urn(spark):
    cases = [
        ("postgres://prod-db:5432/a.b.c", ("postgres://prod-db:5432", "a.b.c", None)),
        ("bigquery/p.d.t", ("bigquery", "p.d.t", None)), ("s3://bucket//file.csv", ("s3://bucket", "/file.csv", None)),
        ("plain", (None, None, "missing_delimiter")), ("s3://bucket", (None, None, "missing_delimiter")),
        ("/t", (None, None, "empty_namespace")), ("ns/", (None, None, "empty_name")),
        ("ns//", (None, None, "empty_name_after_delimiter")),
    ]
    assert [tuple(r) for r in one_by_one(spark, cases, urn.parse_urn)] == [c[1] for c in cases]


def test_aliases(spark):
    resolver = AliasResolver([
        ("demo_postgres/{name}", "postgresql://demo/marts.{name}"), ("s3://bucket/{path*}", "s3://main/{path}"),
        ("a.b/{x}", "lit.{x}"), ("{y}/{y}", "skipped"), ("", "skipped"),
    ])
    check(spark, [
        ("demo_postgres/customers", "postgresql://demo/marts.customers"), ("demo_postgres/a/b", "demo_postgres/a/b"),
        ("s3://bucket/a/b/c", "s3://main/a/b/c"), ("axb/1", "axb/1"), ("a.b/1", "lit.1"), ("q/q", "q/q"), ("", ""),
    ], resolver.resolve)
    check(spark, [("a.b/1", "lit.1"), ("zzz", None)], resolver.match)
    check(spark, [("zzz", "zzz")], AliasResolver().resolve)


def test_alias_file(tmp_path):
    assert alias_file.load_alias_rules(str(tmp_path / "missing.yaml")) == []
    rules = tmp_path / "rules.yaml"
    rules.write_text('{"dataset_patterns": [{"pattern": "a/{x}", "canonical": "b/{x}"}]}')
    assert alias_file.load_alias_rules(str(rules)) == [("a/{x}", "b/{x}")]
    rules.write_text("")
    assert alias_file.load_alias_rules(str(rules)) == []
    rules.write_text("dataset_patterns: [")
    with pytest.raises(alias_file.InvalidAliasFile):
        alias_file.load_alias_rules(str(rules))


def test_producers(spark):
    gh = "https://github.com/"
    check(spark, [
        (gh + "dbt-labs/dbt-core/tree/1.5.0", "dbt-core"), ("", "unknown"), (gh + "a/b/tree/1.0.0/integration/spark", "spark"),
        (gh + "a/b/tree/$V/integration/common/x/provider/great_expectations", "great_expectations"),
        (gh + "short", "github.com"), ("tools.io/x", "tools.io"),
    ], ef.producer_name)
    check(spark, [
        (gh + "dbt-labs/dbt-core/tree/1.5.0", "1.5.0"), (gh + "apache/airflow/tree/providers-x/2.10.0", "2.10.0"),
        (gh + "o/r/v2.1", "v2.1"), (gh + "o/r/tree/main", ""), ("", ""), (gh + "o/r/tree", ""),
    ], ef.producer_version)


def test_times(spark):
    cases = [
        ("2025-10-21T10:05:00Z", "2025-10-21T10:05:00Z"), ("2025-10-21T10:05:00", "2025-10-21T10:05:00Z"),
        ("2025-10-21T10:05:00.120+02:00", "2025-10-21T10:05:00.12+02:00"), ("2025-10-21T9:05:00.000Z", "2025-10-21T09:05:00Z"),
        (" 2025-10-21T10:05:00+00:00 ", "2025-10-21T10:05:00Z"), ("2025-10-21 10:05:00", None), ("soon", None), ("", None),
        ("2025-10-21T10:05:00.1234567891Z", "2025-10-21T10:05:00.123456789Z"),
    ]
    check(spark, cases, ef.event_time_text)
    parsed = one_by_one(spark, [("2025-10-21T10:05:00+02:00",), ("2025-13-41T10:05:00Z",), ("0001-01-01T00:00:00Z",)],
                        lambda x: ef.parse_event_time(x).cast("string"))
    assert parsed == ["2025-10-21 08:05:00", None, None]


def test_event_probe(spark):
    check(spark, [
        ("{}", False), ('{"eventType":null}', False), ('{"eventType":""}', True), ('{"eventType":"START"}', True),
        ('{"dataset":{}}', False), ("{bad", False), ("", False),
    ], events.is_run_event)


def test_assertions(spark):
    values = [("true", "passed"), ("false", "failed"), ('"true"', "failed"), ("1", "failed"), ("null", "failed")]
    cases = [(f'{{"success":{value}}}', status) for value, status in values] + [("{}", "failed")]
    check(spark, cases, lambda x: ef.assertion_status(F.try_parse_json(x)))


def test_parent_ids(spark):
    frame = spark.createDataFrame([
        (1, {"parent": '{"run":{"runId":"p"},"root":{"run":{"runId":"r"}}}'}), (2, {"parent": '{"run":{"runId":5}}'}),
        (3, {"parent": "text"}), (4, {}),
    ], "i int, f map<string,string>")
    rows = frame.orderBy("i").select(ef.parent_run_id(F.col("f")), ef.root_parent_run_id(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [("p", "r"), ("", ""), ("", ""), ("", "")]


def test_ten_thousand_rules_by_index(spark):
    """The index gives every name the target of the first rule that matches it, as trying all rules in order does."""
    import random
    import re

    from causeway.functions.aliases import AliasResolver, RuleIndex, compile_rule

    rng = random.Random(2)
    rules = [("", "x"), ("{a}/{a}", "y")]
    for i in range(10_000):
        n = rng.randrange(6000)
        rules.append(rng.choice([
            (f"tool{n}/{{name}}", f"postgresql://pg/{{name}}.{i}"), (f"tool{n}/a.{{x}}/{{rest*}}", f"$1\\{i}0{{rest}}/{{x}}{{gone}}"),
            (f"tool{n}", f"exact{i}"), (f"s3://b{n % 50}/{{path*}}", f"s3://c/{{path}}{i}")]))
    rules += [("{kind}x9/{name}", "any/{kind}7{name}")]
    names = [f"tool{rng.randrange(6500)}{rng.choice(['', '/n', '/a.b/c/d', '/a.b', '/n/m', 'x9/q'])}" for _ in range(3000)]
    names += [f"s3://b{i}/p/q" for i in range(55)] + ["", "é/ü", None, "y/y"]

    def by_hand(name, given):
        for rule in filter(None, (compile_rule(*r) for r in given)):
            found = re.match(rule.regex.replace(r"\z", r"\Z"), name)
            if found:
                values = dict(zip(rule.variables, found.groups()))
                return re.sub(r"\{([a-z]+)\*?\}", lambda m: values.get(m[1], m[0]), rule.canonical)
        return name

    frame = spark.createDataFrame([(n,) for n in names], "urn string")
    got = [(r.urn, r.canonical_urn) for r in RuleIndex(spark, rules).resolve(frame).collect()]
    assert len(got) == len(names)
    some = dict(rng.sample(got, 150))
    assert {n: c for n, c in some.items()} == {n: None if n is None else by_hand(n, rules) for n in some}
    few = rules[:150]
    chain = {r.urn: r.c for r in frame.select("urn", AliasResolver(few).resolve(F.col("urn")).alias("c")).collect()}
    assert {r.urn: r.canonical_urn for r in RuleIndex(spark, few).resolve(frame).collect()} == chain
