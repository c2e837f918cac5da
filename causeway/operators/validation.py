"""Rules for events, datasets, test results, state sequences and parameters.

Each job adds a reason column that holds the first broken rule, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway.functions import event_fields as ef
from causeway.functions.urn import trimmed
from causeway.operators.ordered import RANGE, arrival_block, range_blocks, with_previous, with_rank
from causeway.session import Scratch

MAX_TEST_NAME_BYTES = 750


def event_reject_reason() -> Column:
    return (
        F.when(~F.col("event_type").isin(*ef.RUN_STATES), "invalid_event_type")
        .when(F.col("event_time").isNull(), "missing_event_time")
        .when(F.col("producer") == "", "missing_producer")
        .when(F.col("schema_url") == "", "missing_schema_url")
        .when(~ef.is_spec_url(F.col("schema_url")), "invalid_schema_url")
        .when(F.col("run_id") == "", "missing_run_id")
        .when(F.col("job_namespace") == "", "missing_job_namespace")
        .when(F.col("job_name") == "", "missing_job_name")
    )


def validate_events(events: DataFrame) -> DataFrame:
    return events.withColumn("reject_reason", event_reject_reason())


def dataset_reject_reason(dataset: Column) -> Column:
    return F.when(dataset["namespace"] == "", "dataset_missing_namespace").when(
        dataset["name"] == "", "dataset_missing_name"
    )


def validate_datasets(events: DataFrame) -> DataFrame:
    """One row per dataset an event mentions, with its broken rule."""
    mentions = events.select(
        "run_id", "arrival",
        F.posexplode(
            F.concat(
                F.transform("outputs", lambda d: F.struct(F.lit("output").alias("edge_type"), d.alias("d"))),
                F.transform("inputs", lambda d: F.struct(F.lit("input").alias("edge_type"), d.alias("d"))),
            )
        ).alias("position", "mention"),
    )
    return mentions.select(
        "run_id", "arrival", "position", "mention.edge_type", "mention.d.namespace", "mention.d.name",
        dataset_reject_reason(F.col("mention.d")).alias("reject_reason"),
    )


def validate_test_results(tests: DataFrame) -> DataFrame:
    def blank(name: str) -> Column:
        return trimmed(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""

    reason = (
        F.when(blank("test_name"), "test_name_empty")
        .when(F.octet_length("test_name") > MAX_TEST_NAME_BYTES, "test_name_too_long")
        .when(blank("dataset_urn"), "dataset_urn_empty")
        .when(~F.contains("dataset_urn", F.lit(":")), "dataset_urn_invalid")
        .when(blank("run_id"), "run_id_empty")
        .when(~F.coalesce(F.col("status").isin(*ef.TEST_STATUSES), F.lit(False)), "status_invalid")
        .when(F.col("executed_at").isNull(), "executed_at_zero")
        .when(F.col("duration_ms") < 0, "duration_ms_negative")
    )
    return tests.withColumn("reject_reason", reason)


def transition_error(before: Column, after: Column) -> Column:
    """Why a run may not go from one state to the next, or null when it may."""
    return (
        F.when(before.isNull() | (before == "OTHER") | (after == "OTHER"), F.lit(None).cast("string"))
        .when(before.isin(*ef.TERMINAL_STATES) & (before != after), "terminal_state_immutable")
        .when(before.isin(*ef.TERMINAL_STATES), F.lit(None).cast("string"))
        .when((before == "START") & (after == "START"), "duplicate_start")
        .when((before == "RUNNING") & (after == "START"), "backward_transition")
        .when(
            before.isin("START", "RUNNING") & after.isin("RUNNING", *ef.TERMINAL_STATES), F.lit(None).cast("string")
        )
        .otherwise("invalid_transition")
    )


def single_run_batches(events: DataFrame) -> DataFrame:
    """Batches of more than one event that all belong to one run: only these are checked as a sequence."""
    return (
        events.groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("run_id").alias("run_id"),
            F.max("run_id").alias("other_run_id"),
            F.min("arrival").alias("first_arrival"),
        )
        .filter((F.col("event_count") > 1) & F.col("run_id").eqNullSafe(F.col("other_run_id")))
        .drop("other_run_id")
    )


def _sortable_time() -> Column:
    # An unreadable time sorts first, as year one does.
    return F.coalesce("event_time", F.lit("0001-01-01").cast("timestamp"))


def _in_time_order(events: DataFrame, scratch: Scratch) -> DataFrame:
    """The events of single-run batches in ranges of (batch, time, arrival)."""
    timed = events.join(single_run_batches(events).select("batch_id"), "batch_id", "left_semi").select(
        "batch_id", "arrival", "event_type", _sortable_time().alias("at"))
    return range_blocks(timed, ["batch_id"], ["at", "arrival"], scratch)


def _sequence_errors(events: DataFrame, timed: DataFrame) -> DataFrame:
    steps = timed.filter(F.col("event_type") != "OTHER")
    order = ["at", "arrival"]
    compared = with_previous(steps, ["batch_id"], order, F.col(RANGE), F.col("event_type"), "before")
    checked = compared.withColumn("problem", transition_error(F.col("before"), F.col("event_type")))
    verdict = checked.groupBy("batch_id").agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.struct(*order))).alias("sequence_error"),
        F.max_by("event_type", F.struct(*order)).alias("last_state"),
    )
    return single_run_batches(events).join(verdict, "batch_id", "left").select(
        "batch_id", "run_id", "event_count", "first_arrival", "sequence_error",
        F.coalesce("last_state", F.lit("OTHER")).alias("final_state"),
    )


def sequence_errors(events: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per single-run batch: its final state and the first illegal transition, if any."""
    return _sequence_errors(events, _in_time_order(events, scratch))


# Events of a batch that are put in order within one task; a larger batch is cut into ranges.
WINDOW_EVENTS = 1 << 16

_AT, _PLACE = "__at", "__place"


def validate_batches(events: DataFrame, scratch: Scratch, window_events: int = WINDOW_EVENTS) -> DataFrame:
    """Event rules plus sequence rules: a bad sequence rejects its whole batch, a bad event only itself.

    The events of an accepted single-run batch are stored in the order of their times, so they
    trade places: the n-th in time gets the n-th smallest arrival of its own batch as its
    ``arrival``. Arrivals stay unique however the messages of batches interleave.
    ``message`` keeps the arrival of the message itself.
    """
    return check_sequences(validate_events(events), scratch, window_events)


def check_sequences(checked: DataFrame, scratch: Scratch, window_events: int = WINDOW_EVENTS) -> DataFrame:
    """``validate_batches`` of events that have their ``reject_reason`` already.

    Every row of a batch goes through one shuffle, by its batch, with all its columns; so hand over only those that
    are asked for. Before it only the sizes of batches are counted, to find the large ones.
    """
    sizes = checked.filter("batch_id IS NOT NULL").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.cut(sizes.filter(F.col("n") > window_events).select("batch_id"))
    batched = checked.filter("batch_id IS NOT NULL")
    parts = [_as_they_are(checked.filter("batch_id IS NULL"))]
    if not large.isEmpty():
        whole = batched.join(large, "batch_id", "left_semi")
        one_run = scratch.cut(single_run_batches(whole).select("batch_id"))
        parts += [_as_they_are(whole.join(one_run, "batch_id", "left_anti")),
                  _placed_in_ranges(whole.join(one_run, "batch_id", "left_semi"), scratch)]
        batched = batched.join(large, "batch_id", "left_anti")
    placed = _placed_at_once(batched)
    for part in parts:
        placed = placed.unionByName(part)
    failed = F.when(F.col("sequence_error").isNotNull(), F.concat(F.lit("invalid_sequence:"), F.col("sequence_error")))
    placed = placed.withColumns({"reject_reason": F.coalesce(failed, "reject_reason"), "arrival": F.col(_PLACE)})
    return placed.drop("sequence_error", _PLACE)


def _as_they_are(rows: DataFrame) -> DataFrame:
    """Rows that keep their places: those of batches of some runs, and those without a batch."""
    return rows.withColumns({"message": F.col("arrival"), _PLACE: F.col("arrival"), "sequence_error": F.lit(None).cast("string")})


def _placed_at_once(rows: DataFrame) -> DataFrame:
    """Rows of batches with their message, place and batch's sequence error; all windows are over the batch."""
    batch = Window.partitionBy("batch_id")
    timed = rows.withColumn(_AT, _sortable_time())
    by_time = batch.orderBy(_AT, "arrival")
    step = F.when(F.col("event_type") != "OTHER", F.col("event_type"))
    before = F.last(step, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(step.isNotNull(), transition_error(F.col("__before"), F.col("event_type")))
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Only batches of more than one event that all belong to one run are put in order.
    one_run = (F.count(F.lit(1)).over(whole) > 1) & F.min("run_id").over(whole).eqNullSafe(F.max("run_id").over(whole))
    judged = (
        timed.withColumns({"__before": before, "__time_rank": F.row_number().over(by_time), "__one_run": one_run})
        .withColumn("__problem", F.when(F.col("__one_run"), problem))
        .withColumn("sequence_error", F.first("__problem", ignorenulls=True).over(whole))
        .withColumn("__arrival_rank", F.row_number().over(batch.orderBy("arrival")))
    )
    # Each rank has two rows: its arrival, and after it the event that gets it. Other batches have the event alone.
    kept = [c for c in (*rows.columns, "sequence_error") if c != "batch_id"]
    nothing = F.lit(None).cast(judged.select(F.struct(*kept)).schema[0].dataType)
    place = F.struct(F.col("__arrival_rank").alias("rank"), F.lit(0).alias("kind"), F.col("arrival").alias("at"), nothing.alias("row"))
    event = F.struct(F.col("__time_rank").alias("rank"), F.lit(1).alias("kind"), F.col("arrival").alias("at"), F.struct(*kept).alias("row"))
    both = F.when(F.col("__one_run"), F.array(place, event)).otherwise(F.array(event))
    ranked = judged.select("batch_id", "__one_run", F.explode(both).alias("e")).select("batch_id", "__one_run", "e.*")
    given = F.lag("at").over(batch.orderBy("rank", "kind"))
    return ranked.withColumn(_PLACE, F.when(F.col("__one_run"), given).otherwise(F.col("at"))).filter("kind = 1").select(
        "batch_id", "row.*", F.col("at").alias("message"), _PLACE)


def _placed_in_ranges(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for batches of any size, cut into ranges."""
    slim = scratch.cut(rows.select("batch_id", "run_id", "arrival", "event_type", "event_time"))
    timed = _in_time_order(slim, scratch)
    sequences = _sequence_errors(slim, timed).select("batch_id", "sequence_error")
    by_time = with_rank(timed, ["batch_id"], ["at", "arrival"], F.col(RANGE), "__rank").select(
        "batch_id", "__rank", F.col("arrival").alias("message"))
    by_arrival = with_rank(timed.select("batch_id", "arrival"), ["batch_id"], ["arrival"], arrival_block(F.col("arrival")), "__rank")
    places = by_time.join(by_arrival, ["batch_id", "__rank"]).select("message", F.col("arrival").alias(_PLACE))
    return rows.join(sequences, "batch_id", "left").join(places, F.col("arrival") == F.col("message"))


def split_events(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected rows carry the reason and are never worth a retry."""
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = checked.filter(F.col("reject_reason").isNotNull()).select(
        "batch_id", "arrival", "run_id", F.col("reject_reason").alias("reason"), F.lit(False).alias("retriable")
    )
    return accepted, rejected


def batch_summary(results: DataFrame) -> DataFrame:
    """Per batch: how many events were received, stored or known, and refused.

    ``results`` has one row per event with ``batch_id`` and ``outcome``
    (stored, duplicate, or rejected).
    """
    failed = F.count_if(F.col("outcome") == "rejected")
    counted = results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("outcome") != "rejected").alias("successful"),
        failed.alias("failed"),
        F.lit(0).cast("bigint").alias("retriable"),
        failed.alias("non_retriable"),
    )
    status = (
        F.when(F.col("failed") == 0, "success").when(F.col("successful") > 0, "partial_success").otherwise("error")
    )
    return counted.withColumn("status", status)


def check_page(limit: int = 20, offset: int = 0, status: str = "active", window_days: int | None = None) -> dict:
    """Parameter rules of the incident list; returns the values in effect."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if status not in ("active", "resolved", "muted", "all"):
        raise ValueError("status must be one of: active, resolved, muted, all")
    if window_days is not None and not 1 <= window_days <= 90:
        raise ValueError("window_days must be between 1 and 90")
    if status == "active":
        window_days = None
    elif window_days is None:
        window_days = 7
    return {"limit": limit, "offset": offset, "status": status, "window_days": window_days}
