"""Resolution state of incidents: manual requests, cascades to retries, auto-resolve.

An incident without a resolution row is open. ``open`` may become acknowledged,
resolved or muted; ``acknowledged`` may become resolved or muted; both of those are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions import event_fields as ef

DEFAULT_MUTE_DAYS = 30
MAX_MUTE_DAYS = 365
GRACE_SECONDS = 3600
FINAL = ("resolved", "muted")

RESOLUTION_COLUMNS = [
    "test_result_id", "status", "resolved_by", "resolution_reason", "resolution_note",
    "resolved_by_test_result_id", "mute_expires_at", "updated_at",
]


def check_requests(requests: DataFrame) -> DataFrame:
    """Apply the request rules: defaults filled in, ``request_error`` set for a broken rule.

    ``requests`` has seq, test_result_id, status, reason, note, mute_days, resolved_by, requested_at.
    """
    status = F.coalesce("status", F.lit(""))
    reason = F.coalesce("reason", F.lit(""))
    days = F.when(F.coalesce("mute_days", F.lit(0)) <= 0, F.lit(DEFAULT_MUTE_DAYS)).otherwise(F.col("mute_days"))
    error = (
        F.when(status == "", "status_required")
        .when(~status.isin("open", "acknowledged", *FINAL), "status_unknown")
        .when(status == "open", "cannot_reopen")
        .when((status == "muted") & (reason == ""), "mute_reason_required")
        .when((status == "muted") & (days > MAX_MUTE_DAYS), "mute_days_too_long")
    )
    return requests.withColumns(
        {
            "request_error": error,
            "reason": F.when(status == "resolved", F.when(reason == "", "manual").otherwise(reason)).when(
                status == "muted", reason
            ).otherwise(F.lit("")),
            "mute_days": F.when(status == "muted", days),
        }
    )


def retry_key(root: Column, test_result_id: Column) -> Column:
    """The root run of the test, or the result's own id when there is none."""
    return F.coalesce(F.nullif(root.cast("string"), F.lit("")), test_result_id.cast("string"))


def incident_groups(incidents: DataFrame) -> DataFrame:
    """(test_result_id, group_key): retries of one test under one root share a key."""
    root = F.col("test_root_parent_run_id").cast("string")
    # An id is no root: the prefix keeps both kinds of key apart.
    key = F.when(
        root.isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit("g"), "test_name", "dataset_urn", root), 256)
    ).otherwise(F.concat(F.lit("i"), F.col("test_result_id").cast("string")))
    return incidents.select("test_result_id", key.alias("group_key"))


def _decided(incidents: DataFrame, resolutions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members with their state, requests with their outcome, accepted requests per group)."""
    state = resolutions.select("test_result_id", F.col("status").alias("old_status"))
    members = (
        incident_groups(incidents)
        .join(state, "test_result_id", "left")
        .withColumn("old_status", ef.resolution_or_open(F.col("old_status")))
    )
    placed = requests.join(members, "test_result_id", "left")
    valid = F.col("request_error").isNull() & F.col("group_key").isNotNull()
    ends = valid & F.col("status").isin(*FINAL) & F.col("old_status").isin("open", "acknowledged")
    notes = valid & (F.col("status") == "acknowledged") & (F.col("old_status") == "open")
    # In a group the first final request that may pass decides: it takes every open member
    # with it. Before that, the first acknowledgement that may pass leaves no member open.
    groups = placed.filter(F.col("group_key").isNotNull()).groupBy("group_key").agg(
        F.min(F.when(ends, F.col("seq"))).alias("end_seq"),
        F.min(F.when(notes, F.col("seq"))).alias("note_seq"),
    )
    groups = groups.withColumn(
        "note_seq", F.when(F.col("end_seq").isNull() | (F.col("note_seq") < F.col("end_seq")), F.col("note_seq"))
    )
    judged = placed.join(groups, "group_key", "left")
    outcome = (
        F.when(F.col("request_error").isNotNull(), F.lit("invalid"))
        .when(F.col("group_key").isNull(), F.lit("not_found"))
        .when((F.col("seq") == F.col("end_seq")) | (F.col("seq") == F.col("note_seq")), F.lit("accepted"))
        .otherwise(F.lit("conflict"))
    )
    return members, judged.withColumn("outcome", outcome), groups


def request_outcomes(incidents: DataFrame, resolutions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: accepted, conflict, not_found or invalid.

    ``incidents`` has one row per incident; ``requests`` is checked and ``seq`` orders it.
    """
    _, judged, _ = _decided(incidents, resolutions, requests)
    return judged.select("seq", "test_result_id", "status", "outcome", "request_error")


def apply_requests(incidents: DataFrame, resolutions: DataFrame, requests: DataFrame, cascade: bool = True) -> DataFrame:
    """The resolution table after all requests, in the order of ``seq``; see ``requested_rows``."""
    return replace_rows(resolutions, requested_rows(incidents, resolutions, requests, cascade))


def requested_rows(incidents: DataFrame, resolutions: DataFrame, requests: DataFrame, cascade: bool = True) -> DataFrame:
    """The resolution rows that the requests, in the order of ``seq``, change.

    With ``cascade`` an accepted request also moves the open retries of the same group.
    """
    members, judged, _ = _decided(_alone(incidents, cascade), resolutions, requests)
    accepted = judged.filter(F.col("outcome") == "accepted")
    change = F.struct(
        "seq", "test_result_id", "status", "resolved_by", "reason", "note", "mute_days", "requested_at"
    )
    is_final = F.col("status").isin(*FINAL)
    # At most one acknowledgement and one final request per group are accepted.
    per_group = accepted.groupBy("group_key").agg(
        F.max_by(change, F.when(is_final, F.col("seq"))).alias("end"),
        F.max_by(change, F.when(~is_final, F.col("seq"))).alias("note"),
    )
    hit = members.join(per_group, "group_key")
    taken = F.when(F.col("end").isNotNull() & F.col("old_status").isin("open", "acknowledged"), F.col("end")).when(
        F.col("note").isNotNull() & (F.col("old_status") == "open"), F.col("note")
    )
    changed = hit.withColumn("c", taken).filter(F.col("c").isNotNull())
    return changed.select(
        "test_result_id",
        F.col("c.status").alias("status"),
        F.col("c.resolved_by").alias("resolved_by"),
        F.col("c.reason").alias("resolution_reason"),
        F.col("c.note").alias("resolution_note"),
        F.lit(None).cast(resolutions.schema["test_result_id"].dataType).alias("resolved_by_test_result_id"),
        F.when(
            F.col("c.status") == "muted", F.col("c.requested_at") + F.make_interval(days=F.col("c.mute_days"))
        ).alias("mute_expires_at"),
        F.col("c.requested_at").alias("updated_at"),
    )


def _alone(incidents: DataFrame, cascade: bool) -> DataFrame:
    """Without cascade every incident is a group of its own."""
    return incidents if cascade else incidents.withColumn("test_root_parent_run_id", F.lit(None).cast("string"))


def replace_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the rows of the same id replaced."""
    kept = table.select(*RESOLUTION_COLUMNS).join(rows.select("test_result_id"), "test_result_id", "left_anti")
    return kept.unionByName(rows.select(*RESOLUTION_COLUMNS))


def auto_resolved(tests: DataFrame, passes: DataFrame, resolutions: DataFrame, as_of: Column,
                  grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """(test_result_id, resolved_by_test_result_id): failures that a pass of the same test resolves.

    Only open or acknowledged failures older than the grace period at ``as_of`` count.
    Passes are first reduced to one per test and dataset, the earliest arrival, so no
    pair of a pass and a failure is ever formed.
    """
    first_pass = passes.groupBy("test_name", "dataset_urn").agg(
        F.min_by("test_result_id", "arrival").alias("resolved_by_test_result_id")
    )
    stale = tests.filter(
        F.col("status").isin(*ef.INCIDENT_STATUSES)
        & (F.col("executed_at") < as_of - F.make_interval(secs=F.lit(grace_seconds)))
    ).select("test_result_id", "test_name", "dataset_urn")
    closed = resolutions.filter(F.col("status").isin(*FINAL)).select("test_result_id")
    return (
        stale.join(first_pass, ["test_name", "dataset_urn"])
        .join(closed, "test_result_id", "left_anti")
        .select("test_result_id", "resolved_by_test_result_id")
    )


def auto_resolve(tests: DataFrame, passes: DataFrame, resolutions: DataFrame, as_of: Column,
                 grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """The resolution table after the passes of one batch; mute dates and notes are kept."""
    hits = auto_resolved(tests, passes, resolutions, as_of, grace_seconds)
    old = resolutions.select("test_result_id", "resolution_note", "mute_expires_at")
    rows = hits.join(old, "test_result_id", "left").withColumns(
        {
            "status": F.lit("resolved"),
            "resolved_by": F.lit("auto"),
            "resolution_reason": F.lit("auto_pass"),
            "updated_at": as_of,
        }
    )
    return replace_rows(resolutions, rows)


def current_resolution(incidents: DataFrame, resolutions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The state of each incident; ``mute_expired`` only reports, it reopens nothing."""
    state = incidents.select("test_result_id").join(resolutions, "test_result_id", "left")
    state = state.withColumn("status", ef.resolution_or_open(F.col("status")))
    if as_of is not None:
        expired = (F.col("status") == "muted") & (F.col("mute_expires_at") < as_of)
        state = state.withColumn("mute_expired", F.coalesce(expired, F.lit(False)))
    return state
