"""Datasets, edges and test results folded from accepted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway import schemas
from causeway.functions import event_fields as ef
from causeway.sources.events import may_hold

# Facet key, field that names the test, and the test type stored.
ASSERTION_FACETS = (
    ("dataQualityAssertions", "assertion", "dataQualityAssertion"),
    ("greatExpectations_assertions", "expectationType", "greatExpectationsAssertion"),
)


def may_hold_tests(value: Column) -> Column:
    """False only for messages in which no assertion facet can be, told without parsing them."""
    return may_hold(value, [key for key, _, _ in ASSERTION_FACETS])


def mentions(events: DataFrame) -> DataFrame:
    """One row per dataset mention in write order: outputs first, then inputs."""
    # Exploded "outer", as Spark puts a filter for empty arrays before any other explode, and so makes the arrays twice.
    tag = lambda kind: lambda d: F.struct(F.lit(kind).alias("edge_type"), d.alias("d"))
    both = F.concat(F.transform("outputs", tag("output")), F.transform("inputs", tag("input")))
    rows = events.select(
        "run_id", "arrival", (F.size("outputs") == 0).alias("is_validator"), F.posexplode_outer(both).alias("position", "m")
    ).filter("position IS NOT NULL")
    return rows.select(
        "run_id", "arrival", "position", "is_validator",
        F.col("m.edge_type").alias("edge_type"),
        F.col("m.d.urn").alias("dataset_urn"),
        F.col("m.d.name").alias("name"),
        F.col("m.d.namespace").alias("namespace"),
        F.col("m.d.facets").alias("facets"),
        F.col("m.d.input_facets").alias("input_facets"),
        F.col("m.d.output_facets").alias("output_facets"),
    )


def written_facets(rows: DataFrame) -> DataFrame:
    """The facets each mention writes: none for a validator's input."""
    written = (
        F.when(
            F.col("edge_type") == "output", ef.flat_facets(F.col("facets"), F.col("output_facets"), "output_")
        )
        .when(~F.col("is_validator"), ef.flat_facets(F.col("facets"), F.col("input_facets"), "input_"))
        .otherwise(F.create_map().cast(schemas.FACETS))
    )
    return rows.withColumn("written", written)


def facet_entries(events: DataFrame) -> DataFrame:
    """One row per facet that a mention writes."""
    return written_facets(mentions(events)).select(
        "dataset_urn", "arrival", "position", F.explode_outer("written").alias("facet", "value")
    ).filter("facet IS NOT NULL")


def fold_facets(events: DataFrame) -> DataFrame:
    """(dataset_urn, facet, value): the last written value of every facet of every dataset."""
    return fold_entries(facet_entries(events))


def fold_entries(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dataset_urn", "facet").agg(
        F.max_by("value", F.struct("arrival", "position")).alias("value")
    )


def slim_mentions(events: DataFrame) -> DataFrame:
    """Mentions without their facets."""
    return mentions(events).select("run_id", "arrival", "position", "edge_type", "dataset_urn", "name", "namespace")


def fold_datasets(events: DataFrame) -> DataFrame:
    """One row per dataset: first name given, last producing run, facets merged key by key."""
    return fold_mentions(slim_mentions(events), facet_entries(events))


def fold_mentions(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The datasets of mentions and of the facets that these write."""
    order = F.struct("arrival", "position")
    base = rows.groupBy("dataset_urn").agg(
        F.min_by(F.struct("name", "namespace"), order).alias("first"),
        F.max_by("run_id", F.when(F.col("edge_type") == "output", order)).alias("last_producing_run_id"),
    )
    # Already one value per facet name here, so a dataset has only as many entries as there are facet names.
    merged = (
        fold_entries(entries)
        .groupBy("dataset_urn")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("facet", "value")))).alias("facets"))
    )
    return base.join(merged, "dataset_urn", "left").select(
        "dataset_urn",
        "first.name",
        "first.namespace",
        F.coalesce("facets", F.create_map().cast(schemas.FACETS)).alias("facets"),
        "last_producing_run_id",
    )


def edge_rows(events: DataFrame) -> DataFrame:
    """One row per dataset that an event mentions as one kind of edge."""
    return mentions(events).select("run_id", "arrival", "dataset_urn", "edge_type")


def fold_edges(events: DataFrame) -> DataFrame:
    return edge_rows(events).select("run_id", "dataset_urn", "edge_type").distinct()


def extract_tests(events: DataFrame) -> DataFrame:
    """Test outcomes in the assertion facets of the inputs, one row per named assertion.

    A facet that is not of the expected shape gives no rows.
    """
    inputs = events.select(
        "run_id", "arrival", "event_time", "producer", F.posexplode_outer("inputs").alias("input_position", "input")
    ).filter("input_position IS NOT NULL")
    facets = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.try_element_at("input.input_facets", F.lit(key)).alias("body"),
                F.lit(field).alias("field"),
                F.lit(test_type).alias("test_type"),
            )
            for rank, (key, field, test_type) in enumerate(ASSERTION_FACETS)
        ]
    )
    bodies = inputs.withColumn("facet", F.explode(facets)).filter(F.col("facet.body").isNotNull())
    listed = F.try_variant_get(F.try_parse_json("facet.body"), "$.assertions", "array<variant>")
    rows = bodies.select("*", F.posexplode(listed).alias("assertion_position", "a"))
    named = F.when(
        F.col("facet.field") == "assertion", ef.variant_string(F.col("a"), "$.assertion")
    ).otherwise(ef.variant_string(F.col("a"), "$.expectationType"))
    column, severity = ef.variant_string(F.col("a"), "$.column"), ef.variant_string(F.col("a"), "$.severity")
    # A severity replaces the column, it is not added to it.
    metadata = F.when(F.coalesce(severity, F.lit("")) != "", F.create_map(F.lit("severity"), severity)).when(
        F.coalesce(column, F.lit("")) != "", F.create_map(F.lit("column"), column)
    )
    return rows.withColumn("test_name", named).filter(F.col("test_name") != "").select(
        "test_name",
        F.col("facet.test_type").alias("test_type"),
        F.col("input.urn").alias("dataset_urn"),
        "run_id",
        ef.assertion_status(F.col("a")).alias("status"),
        metadata.alias("metadata"),
        F.col("input.input_facets").alias("facets"),
        F.col("event_time").alias("executed_at"),
        ef.producer_name(F.col("producer")).alias("producer_name"),
        F.nullif(ef.producer_version(F.col("producer")), F.lit("")).alias("producer_version"),
        "arrival",
        "input_position",
        F.col("facet.rank").alias("facet_rank"),
        "assertion_position",
    )


TEST_KEY = ["test_name", "dataset_urn", "run_id"]


def test_result_id() -> Column:
    """A stable 128-bit id of the result's key, as text."""
    return F.md5(F.concat_ws("\x1f", *TEST_KEY))


def fold_tests(extracted: DataFrame) -> DataFrame:
    """One row per test, dataset and run: the last arrival wins, the id stays the same."""
    order = F.struct("arrival", "input_position", "facet_rank", "assertion_position")
    kept = [c for c in extracted.columns if c not in (*TEST_KEY, "arrival", "input_position", "facet_rank",
                                                      "assertion_position")]
    last = extracted.groupBy(*TEST_KEY).agg(
        F.max_by(F.struct(*kept), order).alias("r"), F.max("arrival").alias("arrival")
    )
    return last.select(test_result_id().alias("test_result_id"), *TEST_KEY, "r.*", "arrival").withColumns(
        {"message": F.lit(""), "duration_ms": F.lit(0)}
    )
