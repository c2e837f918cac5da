"""Duplicate events: the same identity key within a day of its last accepted copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.operators.ordered import RANGE, range_blocks, with_earlier_max
from causeway.session import Scratch

TTL_HOURS = 24


def _later(time: Column, hours: int) -> Column:
    return time + F.make_interval(hours=F.lit(hours))


def accepted_copies(events: DataFrame, scratch: Scratch, ttl_hours: int = TTL_HOURS, also: tuple[str, ...] = ()) -> DataFrame:
    """(arrival, idempotency_key, ingested_at, expires_at) of every copy that is stored, and its columns in ``also``.

    The first copy is stored; a later one only when it comes ``ttl_hours`` or more
    after the last stored one. ``events`` are gone over more than once, so hand over a written table. Only
    events whose key others may have too are compared by their keys.
    """
    columns = ["idempotency_key", "arrival", "ingested_at", *also]
    marked = events.select(*columns, key_mark(F.col("idempotency_key")))
    dropped = dropped_copies(scratch.cut(alike(marked, scratch).select(*columns)), scratch, ttl_hours)
    kept = events.select(*columns).join(dropped, "arrival", "left_anti")
    return kept.withColumn("expires_at", _later(F.col("ingested_at"), ttl_hours)).select(
        "idempotency_key", "arrival", "ingested_at", "expires_at", *also)


MARK = "key_mark"


def key_mark(key: Column) -> Column:
    """Eight bytes that are the same for the same key; an event whose mark no other has is no copy."""
    return F.xxhash64(key).alias(MARK)


def alike(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose mark others have too."""
    shared = marked.groupBy(MARK).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(MARK)
    return marked.join(scratch.cut(shared), MARK, "left_semi")


def expires_at(ingested_at: Column, ttl_hours: int = TTL_HOURS) -> Column:
    return _later(ingested_at, ttl_hours)


def dropped_copies(events: DataFrame, scratch: Scratch, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """(arrival) of the copies that are not stored.

    A key whose copies all lie within ``ttl_hours`` ends with one
    combining aggregation. For the others each copy is linked to the first one that much later, and
    the links are followed from the first copy on in doubled jumps, so a key with n stored
    copies takes log n rounds, and its copies are never brought together.
    """
    columns = ["ingested_at", "arrival"]
    ends = events.groupBy("idempotency_key").agg(F.min(F.struct(*columns)).alias("first"), F.max("ingested_at").alias("last"))
    ends = scratch.cut(ends.select("idempotency_key", "first.*", (F.col("last") >= _later(F.col("first.ingested_at"), ttl_hours)).alias("again")))
    kept = ends.select("arrival")
    again = ends.filter("again")
    if not again.isEmpty():
        again = scratch.cut(again.select("idempotency_key", "arrival"))
        copies = events.join(again.select("idempotency_key"), "idempotency_key", "left_semi")
        moments = copies.groupBy("idempotency_key", "ingested_at").agg(F.min("arrival").alias("arrival"))
        links = scratch.cut(next_copies(scratch.cut(moments), scratch, ttl_hours))
        kept = kept.unionByName(_followed(again.select("arrival"), links, scratch))
    return scratch.cut(events.select("arrival").join(kept, "arrival", "left_anti"))


def next_copies(moments: DataFrame, scratch: Scratch, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """(arrival, following): of each copy the first copy of its key that is ``ttl_hours`` or more later.

    Copies, and the moments they reach to, are gone through from the newest on; the last copy met is the answer.
    """
    copies = moments.select("idempotency_key", (-F.unix_micros("ingested_at")).alias("back"), F.lit(0).alias("kind"), "arrival")
    reach = moments.select("idempotency_key", (-F.unix_micros(_later(F.col("ingested_at"), ttl_hours))).alias("back"), F.lit(1).alias("kind"), "arrival")
    key, order = ["idempotency_key"], ["back", "kind", "arrival"]
    ranged = range_blocks(copies.unionByName(reach), key, order, scratch)
    value = F.when(F.col("kind") == 0, F.struct("back", (-F.col("arrival")).alias("minus")))
    met = with_earlier_max(ranged, key, order, F.col(RANGE), value, "met")
    return met.filter("kind = 1 AND met IS NOT NULL").select("arrival", (-F.col("met.minus")).alias("following"))


def _followed(starts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(arrival) of what the links (arrival, following) lead to from the starts, in doubled jumps."""
    reached, jump = starts, links
    while True:
        ahead = scratch.cut(reached.join(jump, "arrival").select(F.col("following").alias("arrival")))
        if ahead.isEmpty():
            return reached.join(starts, "arrival", "left_anti")
        reached = scratch.cut(reached.union(ahead))
        onward = jump.select(F.col("arrival").alias("following"), F.col("following").alias("beyond"))
        jump = scratch.cut(jump.join(onward, "following").select("arrival", F.col("beyond").alias("following")))


def drop_duplicates(events: DataFrame, scratch: Scratch, ttl_hours: int = TTL_HOURS) -> DataFrame:
    copies = accepted_copies(events, scratch, ttl_hours).select("arrival")
    return events.join(copies, "arrival", "left_semi")


def live_keys(keys: DataFrame, as_of: Column) -> DataFrame:
    """The key table without the entries that have expired."""
    return keys.filter(F.col("expires_at") >= as_of)


def known_keys(events: DataFrame, keys: DataFrame, itself: bool = True) -> DataFrame:
    """Events of a new batch that repeat a live stored key.

    A key lives from the ingest time of its message until ``expires_at``. Without ``itself`` a message
    does not count as a repetition of its own key, so a batch that is done again comes out the same.
    """
    last = F.max_by(F.struct("arrival", "ingested_at", "expires_at"), F.struct("expires_at", "arrival"))
    stored = keys.groupBy("idempotency_key").agg(last.alias("__key"))
    known = events.join(stored, "idempotency_key").filter(F.col("__key.expires_at") > F.col("ingested_at"))
    if not itself:
        known = known.filter(
            (F.col("__key.arrival") != F.col("arrival")) & (F.col("__key.ingested_at") <= F.col("ingested_at")))
    return known.drop("__key")
