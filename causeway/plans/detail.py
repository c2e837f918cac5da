"""Incident list with enrichment, and the full detail of incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions import event_fields as ef
from causeway.plans import graph, health, incidents
from causeway.plans.incidents import Tables
from causeway.session import Scratch


def enrich(listed: DataFrame, counts: DataFrame, orphan_urns: DataFrame) -> DataFrame:
    """Add how many datasets lie downstream, and whether the dataset has a naming issue."""
    flagged = orphan_urns.select("dataset_urn", F.lit(True).alias("has_correlation_issue")).distinct()
    by_run = counts.withColumnRenamed("run_id", "job_run_id")
    return (
        listed.join(by_run, "job_run_id", "left")
        .join(flagged, "dataset_urn", "left")
        .withColumns(
            {
                "downstream_count": F.coalesce("downstream_count", F.lit(0).cast("bigint")),
                "has_correlation_issue": F.coalesce("has_correlation_issue", F.lit(False)),
            }
        )
    )


def incident_list(tables: Tables, scratch: Scratch, as_of: Column, wanted: incidents.IncidentFilter | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """The list with its enrichment. Pass ``counts`` of a stored impact view to spare the expansion;
    else only the runs on the list are expanded."""
    listed = incidents.list_incidents(tables, as_of, wanted)
    if counts is None:
        listed = scratch.cut(listed)
        runs = listed.select(F.col("job_run_id").alias("run_id"))
        counts = graph.downstream_counts(graph.impact(tables, scratch, runs))
    return enrich(listed, counts, health.unproduced(tables))


def list_totals(enriched: DataFrame, orphan_urns: DataFrame) -> DataFrame:
    """Totals of the list response."""
    orphan_count = orphan_urns.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return enriched.agg(F.count(F.lit(1)).alias("total")).select("total", orphan_count.alias("orphan_count"))


def incident_heads(tables: Tables, scratch: Scratch) -> DataFrame:
    """The head of every incident's detail: test, dataset, producing run, parents and state."""
    made = incidents.with_parents(tables, incidents.latest_producers(incidents.producers(tables)))
    tests = incidents.with_test_root(tables, incidents.failing_tests(tables))
    heads = incidents.with_resolution(tables, tests.join(made, "dataset_urn"))
    orphan_urns = health.unproduced(tables).select("dataset_urn", F.lit(True).alias("is_orphan"))
    status, parent = F.col("job_status"), F.col("parent_job_status")
    attempts = incidents.retry_attempts(tables, scratch).select("test_result_id", "total_attempts")
    with_status = heads.join(orphan_urns, "dataset_urn", "left").join(attempts, "test_result_id", "left")
    in_group = F.col("test_root_parent_run_id").isNotNull()
    return with_status.select(
        *incidents.VIEW_COLUMNS,
        ef.effective_job_status(status, parent).alias("effective_job_status"),
        ef.effective_completed_at(
            status, parent, F.col("job_completed_at"), F.col("parent_job_completed_at")
        ).alias("effective_completed_at"),
        ef.correlation_status(F.col("job_run_id").cast("string"), F.col("is_orphan")).alias("correlation_status"),
        ef.resolution_or_open(F.col("resolution_status")).alias("resolution_status"),
        "resolved_by", "resolution_reason", "mute_expires_at",
        # A detail counts its incident as the latest attempt.
        F.when(in_group, F.col("total_attempts")).otherwise(F.lit(1)).cast("bigint").alias("total_attempts"),
    )


@dataclass(frozen=True)
class Details:
    """The detail of many incidents as related tables: a tree of any size never becomes one value."""

    heads: DataFrame
    upstream: DataFrame
    downstream: DataFrame
    chains: DataFrame
    attempts: DataFrame


def details(tables: Tables, scratch: Scratch, wanted: DataFrame | None = None) -> Details:
    """Heads plus trees and chains, the latter keyed by the producing run of the incident."""
    heads = incident_heads(tables, scratch)
    if wanted is not None:
        heads = heads.join(wanted.select("test_result_id").distinct(), "test_result_id", "left_semi")
    heads = scratch.cut(heads)
    starts = heads.select("dataset_urn", F.col("job_run_id").alias("run_id")).distinct()
    attempts = incidents.attempt_rows(tables, scratch)
    shown = scratch.cut(attempts.join(heads.select("test_result_id"), "test_result_id", "left_semi")
                        .select("test_name", "dataset_urn", "retry_key").distinct())
    return Details(
        heads=heads,
        upstream=graph.upstream_trees(tables, scratch, starts),
        downstream=graph.downstream_trees(tables, scratch, starts),
        chains=graph.orchestration_chains(tables, scratch, starts),
        # All attempts of the retry groups of these incidents; the siblings are the other rows of a group.
        attempts=attempts.join(shown, ["test_name", "dataset_urn", "retry_key"], "left_semi"),
    )
