"""Incidents: failed tests matched to the runs that produced the tested dataset.

``tables`` bundles the stored tables. The canonical name of a dataset is a column
expression over its URN, so matching names across tools costs no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions import event_fields as ef
from causeway.functions.aliases import AliasResolver
from causeway.operators.ordered import RANGE, range_blocks, with_rank
from causeway.operators.resolution import retry_key
from causeway.session import Scratch


@dataclass(frozen=True)
class Tables:
    runs: DataFrame
    datasets: DataFrame
    edges: DataFrame
    tests: DataFrame
    resolutions: DataFrame
    aliases: AliasResolver = field(default_factory=AliasResolver)

    def canonical(self, urn: Column | str) -> Column:
        return self.aliases.resolve(F.col(urn) if isinstance(urn, str) else urn)


def all_urns(tables: Tables) -> DataFrame:
    """Every dataset URN that any table mentions."""
    sources = [tables.datasets, tables.tests, tables.edges]
    urns = [source.select(F.col("dataset_urn").alias("raw_urn")) for source in sources]
    return urns[0].union(urns[1]).union(urns[2]).distinct()


def resolved_datasets(tables: Tables) -> DataFrame:
    """(raw_urn, canonical_urn), rebuilt whole so that stale names fall out."""
    return all_urns(tables).withColumn("canonical_urn", tables.canonical("raw_urn"))


def stale_resolved(tables: Tables, stored: DataFrame) -> DataFrame:
    """Rows of a stored lookup whose name no table mentions any more."""
    return stored.join(all_urns(tables), "raw_urn", "left_anti")


def failing_tests(tables: Tables) -> DataFrame:
    """Failed and errored results with their canonical dataset."""
    failed = tables.tests.filter(F.col("status").isin(*ef.INCIDENT_STATUSES))
    return failed.select(
        "test_result_id",
        "test_name",
        "test_type",
        F.col("status").alias("test_status"),
        F.col("message").alias("test_message"),
        F.col("executed_at").alias("test_executed_at"),
        F.col("duration_ms").alias("test_duration_ms"),
        F.col("producer_name").alias("test_producer_name"),
        F.col("run_id").alias("test_run_id"),
        tables.canonical("dataset_urn").alias("dataset_urn"),
    )


def producers(tables: Tables) -> DataFrame:
    """One row per output edge: the produced dataset under its canonical name, and the run."""
    outputs = tables.edges.filter(F.col("edge_type") == "output").select("run_id", "dataset_urn")
    named = outputs.join(
        tables.datasets.select("dataset_urn", F.col("name").alias("dataset_name"), F.col("namespace").alias("dataset_namespace")),
        "dataset_urn",
    )
    runs = tables.runs.select(
        "run_id",
        "job_name",
        "job_namespace",
        F.col("current_state").alias("job_status"),
        F.col("event_type").alias("job_event_type"),
        F.col("started_at").alias("job_started_at"),
        F.col("completed_at").alias("job_completed_at"),
        F.col("producer_name").alias("job_producer_name"),
        "parent_run_id",
        "root_parent_run_id",
    )
    return named.join(runs, "run_id").select(
        tables.canonical("dataset_urn").alias("dataset_urn"),
        F.col("dataset_urn").alias("produced_urn"),
        "dataset_name", "dataset_namespace",
        F.col("run_id").alias("job_run_id"),
        "job_name", "job_namespace", "job_status", "job_event_type", "job_started_at", "job_completed_at",
        "job_producer_name", "parent_run_id", "root_parent_run_id",
    )


_PRODUCER_COLUMNS = [
    "produced_urn", "dataset_name", "dataset_namespace", "job_run_id", "job_name", "job_namespace", "job_status",
    "job_event_type", "job_started_at", "job_completed_at", "job_producer_name", "parent_run_id", "root_parent_run_id",
]


def latest_producers(produced: DataFrame) -> DataFrame:
    """The most recently started producer of each canonical dataset.

    Combined before the shuffle, so a dataset that a third of all runs write still
    leaves one row per task. Ties go to the smaller run id, then the smaller URN.
    """
    order = F.struct(-F.unix_micros(F.col("job_started_at").cast("timestamp")), "job_run_id", "produced_urn")
    best = produced.groupBy("dataset_urn").agg(F.min_by(F.struct(*_PRODUCER_COLUMNS), order).alias("p"))
    return best.select("dataset_urn", "p.*")


def _run_columns(tables: Tables, prefix: str) -> DataFrame:
    return tables.runs.select(
        F.col("run_id").alias(f"__{prefix}_id"),
        F.col("job_name").alias(f"{prefix}_job_name"),
        F.col("job_namespace").alias(f"{prefix}_job_namespace"),
        F.col("current_state").alias(f"{prefix}_job_status"),
        F.col("completed_at").alias(f"{prefix}_job_completed_at"),
        F.col("producer_name").alias(f"{prefix}_producer_name"),
    )


def with_parents(tables: Tables, produced: DataFrame) -> DataFrame:
    """Add the parent run and the root parent run; either may be unknown."""
    parent, root = _run_columns(tables, "parent"), _run_columns(tables, "root_parent")
    return (
        produced.join(parent, F.col("parent_run_id") == F.col("__parent_id"), "left")
        .join(root, F.col("root_parent_run_id") == F.col("__root_parent_id"), "left")
        .drop("__parent_id", "__root_parent_id")
    )


def with_test_root(tables: Tables, tests: DataFrame) -> DataFrame:
    """Add the root parent of the run that executed the test: the key of its retries."""
    roots = tables.runs.select(
        F.col("run_id").alias("test_run_id"), F.col("root_parent_run_id").alias("test_root_parent_run_id")
    )
    return tests.join(roots, "test_run_id", "left")


VIEW_COLUMNS = [
    "test_result_id", "test_name", "test_type", "test_status", "test_message", "test_executed_at",
    "test_duration_ms", "test_producer_name", "dataset_urn", "dataset_name", "dataset_namespace", "job_run_id",
    "job_name", "job_namespace", "job_status", "job_event_type", "job_started_at", "job_completed_at",
    "job_producer_name", "parent_run_id", "parent_job_name", "parent_job_namespace", "parent_job_status",
    "parent_job_completed_at", "parent_producer_name", "root_parent_run_id", "root_parent_job_name",
    "root_parent_job_namespace", "root_parent_job_status", "root_parent_job_completed_at",
    "root_parent_producer_name", "test_root_parent_run_id",
]


def correlated_runs(tables: Tables) -> DataFrame:
    """(test_result_id, dataset_urn, produced_urn, job_run_id): each failed test with every producing run."""
    made = producers(tables).select("dataset_urn", "produced_urn", "job_run_id")
    return failing_tests(tables).select("test_result_id", "dataset_urn").join(made, "dataset_urn")


def incident_view(tables: Tables) -> DataFrame:
    """The correlation view: one row per failed test and producing run.

    Parents are joined to the producers and roots to the tests first, so the
    many-to-many step comes last. The reports below never read this view; they use
    one producer per dataset and so do not grow with the pairs.
    """
    tests = with_test_root(tables, failing_tests(tables))
    made = with_parents(tables, producers(tables))
    return tests.join(made, "dataset_urn").select(*VIEW_COLUMNS)


@dataclass(frozen=True)
class IncidentFilter:
    """Conditions of the incident list; ``status`` None means no resolution condition."""

    job_status: str | None = None
    job_producer_name: str | None = None
    dataset_urn: str | None = None
    run_id: str | None = None
    executed_after: object = None
    executed_before: object = None
    status: str | None = "active"
    window_days: int | None = None


def filter_tests(tests: DataFrame, wanted: IncidentFilter) -> DataFrame:
    if wanted.dataset_urn is not None:
        tests = tests.filter(F.col("dataset_urn") == wanted.dataset_urn)
    if wanted.executed_after is not None:
        tests = tests.filter(F.col("test_executed_at") > F.lit(wanted.executed_after))
    if wanted.executed_before is not None:
        tests = tests.filter(F.col("test_executed_at") < F.lit(wanted.executed_before))
    return tests


def filter_producers(produced: DataFrame, wanted: IncidentFilter) -> DataFrame:
    conditions = {
        "job_status": wanted.job_status,
        "job_producer_name": wanted.job_producer_name,
        "dataset_urn": wanted.dataset_urn,
        "job_run_id": wanted.run_id,
    }
    for column, value in conditions.items():
        if value is not None:
            produced = produced.filter(F.col(column) == value)
    return produced


def resolution_condition(status: str | None, window_days: int | None, as_of: Column) -> Column:
    """Which resolution states a list shows; the window only limits resolved and muted rows."""
    state = F.col("resolution_status")
    active = state.isNull() | state.isin("open", "acknowledged")
    if status is None:
        return F.lit(True)
    if status in ("active", ""):
        return active
    recent = F.lit(True)
    if window_days:
        recent = F.col("resolution_updated_at") >= as_of - F.make_interval(days=F.lit(window_days))
    if status == "all":
        return active | recent
    return (state == status) & recent


def with_resolution(tables: Tables, tests: DataFrame) -> DataFrame:
    state = tables.resolutions.select(
        "test_result_id",
        F.col("status").alias("resolution_status"),
        "resolved_by",
        "resolution_reason",
        "mute_expires_at",
        F.col("updated_at").alias("resolution_updated_at"),
    )
    return tests.join(state, "test_result_id", "left")


def _grouped(tests: DataFrame, carried: list[str]) -> DataFrame:
    """One row per retry group: its newest test, how many there are, and whether all failed.

    The newest row, its attempt number and the group size come from one combining
    aggregation instead of windows, so a group of any size fits.
    """
    key = retry_key(F.col("test_root_parent_run_id"), F.col("test_result_id"))
    newest = F.struct("test_executed_at", "test_result_id")
    groups = tests.withColumn("__key", key).groupBy("test_name", "dataset_urn", "__key").agg(
        F.max_by(F.struct(*carried), newest).alias("t"),
        F.count(F.lit(1)).alias("total_attempts"),
        F.bool_and(F.col("test_status").isin(*ef.INCIDENT_STATUSES)).alias("all_failed"),
    )
    return groups.select("test_name", "dataset_urn", "t.*", "total_attempts", "all_failed")


_TEST_COLUMNS = [
    "test_result_id", "test_type", "test_status", "test_message", "test_executed_at", "test_duration_ms",
    "test_producer_name", "test_root_parent_run_id", "resolution_status", "resolved_by", "resolution_reason",
    "mute_expires_at", "resolution_updated_at",
]


def list_incidents(tables: Tables, as_of: Column, wanted: IncidentFilter | None = None) -> DataFrame:
    """One row per retry group among the incidents that pass the filter.

    The filter comes before the grouping on purpose: attempts that do not pass are
    not counted, and an older attempt shows when the newest one does not pass.
    All tests of a group share one dataset, hence one producer row, so producers are
    joined after the grouping.
    """
    wanted = wanted or IncidentFilter(status=None)
    tests = filter_tests(failing_tests(tables), wanted)
    tests = with_resolution(tables, tests).filter(resolution_condition(wanted.status, wanted.window_days, as_of))
    groups = _grouped(with_test_root(tables, tests), _TEST_COLUMNS)
    made = latest_producers(filter_producers(producers(tables), wanted)).drop(
        "produced_urn", "parent_run_id", "root_parent_run_id"
    )
    listed = groups.join(made, "dataset_urn")
    return listed.withColumns(
        {
            "current_attempt": F.col("total_attempts"),
            "has_retry_context": F.col("total_attempts") > 1,
            "resolution_status": ef.resolution_or_open(F.col("resolution_status")),
        }
    )


def page(incidents: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, newest first, with the total; a page past the end is empty."""
    total = incidents.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    order = [F.col("test_executed_at").desc(), F.col("test_result_id").desc()]
    return incidents.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total)


def filter_view(incidents: DataFrame, choice: str = "all") -> DataFrame:
    """The filters of the list screen."""
    if choice in ("failed", "passed"):
        return incidents.filter(F.col("test_status") == choice)
    if choice == "correlation_issues":
        return incidents.filter(F.col("has_correlation_issue"))
    return incidents


def incident_heads(tables: Tables) -> DataFrame:
    """One row per incident with its newest producer."""
    tests = with_test_root(tables, failing_tests(tables))
    return tests.join(latest_producers(producers(tables)), "dataset_urn")


def incident_keys(tables: Tables) -> DataFrame:
    """One slim row per incident: what the resolution jobs need."""
    made = producers(tables).select("dataset_urn").distinct()
    tests = failing_tests(tables).select("test_result_id", "test_name", "dataset_urn", "test_run_id",
                                         "test_status", "test_executed_at")
    return with_test_root(tables, tests.join(made, "dataset_urn", "left_semi"))


def count_incidents(tables: Tables, as_of: Column, window_days: int = 30) -> DataFrame:
    """Active, resolved and muted incidents, one per retry group.

    Unlike the list, groups are formed before the state is looked at: only the newest attempt counts.
    """
    groups = _grouped(incident_keys(tables), ["test_result_id", "test_status"])
    judged = with_resolution(tables, groups)
    state = F.col("resolution_status")
    recent = F.col("resolution_updated_at") >= as_of - F.make_interval(days=F.lit(window_days))
    return judged.agg(
        F.count_if(state.isNull() | state.isin("open", "acknowledged")).alias("active"),
        F.count_if((state == "resolved") & recent).alias("resolved"),
        F.count_if((state == "muted") & recent).alias("muted"),
    )


def retry_attempts(tables: Tables, scratch: Scratch) -> DataFrame:
    """Every incident with its place among its retries (oldest first) and the size of its group.

    The siblings of an incident are the other rows of its group; seen from incident i
    a sibling's number is its place, less one when it comes after i.
    """
    keys = incident_keys(tables).withColumn(
        "retry_key", retry_key(F.col("test_root_parent_run_id"), F.col("test_result_id"))
    )
    group = ["test_name", "dataset_urn", "retry_key"]
    order = ["test_executed_at", "test_result_id"]
    keys = range_blocks(keys, group, order, scratch)
    ranked = with_rank(keys, group, order, F.col(RANGE), "attempt").drop(RANGE)
    sizes = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("total_attempts"))
    return ranked.join(sizes, group)


def attempt_rows(tables: Tables, scratch: Scratch) -> DataFrame:
    """What the detail shows of each attempt: its number, state, resolution and producing run.

    One row per incident; a group of n attempts has n rows, not n times n.
    """
    made = latest_producers(producers(tables)).select("dataset_urn", "job_run_id")
    return with_resolution(tables, retry_attempts(tables, scratch).join(made, "dataset_urn")).select(
        "test_name", "dataset_urn", "retry_key", "test_result_id", "attempt", "total_attempts", "test_status",
        "test_executed_at", "job_run_id", ef.resolution_or_open(F.col("resolution_status")).alias("resolution_status"),
    )


def other_attempts(tables: Tables, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The siblings of the given incidents, numbered without the incident itself.

    ``wanted`` lists the ids a user asked for; for all incidents take ``attempt_rows``.
    """
    attempts = attempt_rows(tables, scratch).filter(F.col("total_attempts") > 1)
    group = ["test_name", "dataset_urn", "retry_key"]
    asked = attempts.join(wanted.select("test_result_id").distinct(), "test_result_id").select(
        *group, F.col("test_result_id").alias("incident_id"), F.col("attempt").alias("own_attempt")
    )
    siblings = attempts.join(asked, group).filter(F.col("test_result_id") != F.col("incident_id"))
    return siblings.select(
        "incident_id", "test_result_id",
        (F.col("attempt") - F.when(F.col("attempt") > F.col("own_attempt"), 1).otherwise(0)).alias("attempt"),
        "test_status", "test_executed_at", "job_run_id", "resolution_status",
    )
