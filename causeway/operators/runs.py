"""Runs: which events are accepted, the state of each run and its history.

Events carry a unique ``arrival`` number. The newest event time wins, whatever the
order of arrival; an event that would move a run out of an end state is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions import event_fields as ef
from causeway.operators.ordered import ARRIVAL_BLOCK, arrival_block, with_earlier_max, with_previous
from causeway.session import Scratch

_RUN = ["run_id"]
_ORDER = ["arrival"]


def _terminal(state: Column) -> Column:
    return state.isin(*ef.TERMINAL_STATES)


def refused_events(events: DataFrame, block_width: int = ARRIVAL_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(arrival, run_id) of the events that the end-state rule refuses.

    A run ends at its first terminal event that is strictly newer than everything
    before it. Later events of that same type are accepted; any other type is
    refused when it is newer than the end and all its accepted repetitions.
    With ``scratch`` the events of runs that can have a refused one are written, so all events are shuffled once, not for each step.
    """
    block = arrival_block(F.col("arrival"), block_width)
    slim = events.select("run_id", "arrival", "event_type", "event_time")
    # Only a run with events after a terminal one can have a refused event; one combining aggregation finds those.
    first_end = F.min(F.when(_terminal(F.col("event_type")), F.col("arrival")))
    followed = slim.groupBy("run_id").agg(first_end.alias("first"), F.max("arrival").alias("last")).filter("last > first")
    slim = slim.join(followed.select("run_id"), "run_id", "left_semi")
    if scratch is not None:
        slim = scratch.cut(slim)
    seen = with_earlier_max(slim, _RUN, _ORDER, block, F.col("event_time"), "__top")
    newest = F.col("__top").isNull() | (F.col("event_time") > F.col("__top"))
    ended = (
        seen.groupBy("run_id")
        .agg(
            F.min_by(
                F.struct(F.col("arrival").alias("at"), F.col("event_type").alias("state"), F.col("event_time").alias("t")),
                F.when(newest & _terminal(F.col("event_type")), F.col("arrival")),
            ).alias("end"),
            F.max("arrival").alias("last_arrival"),
        )
        .filter(F.col("last_arrival") > F.col("end.at"))
        .select("run_id", "end")
    )
    after = slim.join(ended, "run_id").filter(F.col("arrival") > F.col("end.at"))
    repeats = F.when(F.col("event_type") == F.col("end.state"), F.col("event_time"))
    with_limit = with_earlier_max(after, _RUN, _ORDER, block, repeats, "__repeat")
    limit = F.greatest(F.col("end.t"), F.col("__repeat"))
    refused = (F.col("event_type") != F.col("end.state")) & (F.col("event_time") > limit)
    return with_limit.filter(refused).select("arrival", "run_id")


def accept_events(events: DataFrame, block_width: int = ARRIVAL_BLOCK) -> DataFrame:
    """The events without the refused ones."""
    return events.join(refused_events(events, block_width).select("arrival"), "arrival", "left_anti")


def run_fields(events: DataFrame) -> DataFrame:
    """What the fold of runs asks of each event, with the fields of its facets taken out."""
    return events.select(
        "run_id", "arrival", "event_type", "event_time", "job_name", "job_namespace", "producer",
        ef.parent_run_id(F.col("run_facets")).alias("parent"),
        ef.root_parent_run_id(F.col("run_facets")).alias("root"),
        ef.run_metadata(F.col("job_facets"), F.col("run_facets"), F.col("producer"), F.col("schema_url")).alias("metadata"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run from its accepted events."""
    return fold_run_fields(run_fields(events))


def fold_run_fields(fields: DataFrame) -> DataFrame:
    """One row per run from the fields of its accepted events: one aggregation with map-side combine."""
    typed = fields.withColumn("version", ef.producer_version(F.col("producer")))

    def last_given(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name) != "", F.col("arrival")))

    # Ties in event time keep the earlier arrival.
    newest = F.struct(F.col("event_time"), -F.col("arrival"))
    first = F.struct("job_name", "job_namespace", "producer", F.col("event_time").alias("started_at"))
    folded = typed.groupBy("run_id").agg(
        F.max_by(F.struct("event_type", "event_time"), newest).alias("state"),
        # Apart from the state, so it is not carried where nobody asks for it.
        F.max_by("metadata", newest).alias("metadata"),
        F.min_by(first, F.col("arrival")).alias("first"),
        last_given("version").alias("producer_version"),
        last_given("parent").alias("parent_run_id"),
        last_given("root").alias("root_parent_run_id"),
    )
    return folded.select(
        "run_id",
        "first.job_name",
        "first.job_namespace",
        F.col("state.event_type").alias("current_state"),
        F.col("state.event_type").alias("event_type"),
        F.col("state.event_time").alias("event_time"),
        F.col("first.started_at").alias("started_at"),
        F.when(_terminal(F.col("state.event_type")), F.col("state.event_time")).alias("completed_at"),
        "parent_run_id",
        "root_parent_run_id",
        ef.producer_name(F.col("first.producer")).alias("producer_name"),
        F.coalesce("producer_version", F.lit("")).alias("producer_version"),
        "metadata",
    )


def state_changes(events: DataFrame, block_width: int = ARRIVAL_BLOCK) -> DataFrame:
    """The history of each run: its first state, then every event that was newer and changed the state."""
    block = arrival_block(F.col("arrival"), block_width)
    updated_at = F.col("ingested_at") if "ingested_at" in events.columns else F.col("event_time")
    slim = events.select("run_id", "arrival", "event_type", "event_time", updated_at.alias("updated_at"))
    seen = with_earlier_max(slim, _RUN, _ORDER, block, F.col("event_time"), "__top", keep_blocks=True)
    setting = seen.filter(F.col("__top").isNull() | (F.col("event_time") > F.col("__top"))).drop("__top")
    chained = with_previous(setting, _RUN, _ORDER, block, F.col("event_type"), "from_state")
    changed = F.col("from_state").isNull() | (F.col("from_state") != F.col("event_type"))
    return chained.filter(changed).select(
        "run_id", "arrival", "from_state", F.col("event_type").alias("to_state"), "event_time", "updated_at"
    )
