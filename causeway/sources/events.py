"""Reading run events: request files, message streams and their normalised form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causeway import schemas
from causeway.functions import event_fields as ef
from causeway.operators.ordered import RANGE, range_blocks, with_rank
from causeway.session import Scratch
from causeway.functions.urn import dataset_urn, trimmed, urn_error, urn_name, urn_namespace

DEFAULT_TOPIC = "openlineage.events"


def read_event_batch(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Files that hold one JSON array of events each: (events, refused files).

    Every file is one batch, received when it was last changed. Events get ``batch_id``, ``arrival`` (by
    time and name of the file, then by place in the array) and ``ingested_at``. A file that is no
    JSON array, or an empty one, is refused with a reason and does not concern the others.
    """
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("ingested_at"))
    parsed = files.withColumn("events", F.from_json("value", f"array<{schemas.WIRE_EVENT_TYPE}>"))
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    reason = F.when(~is_list | F.col("events").isNull(), "not_an_event_array").when(F.size("events") == 0, "empty_event_array")
    judged = scratch.cut(parsed.select("source_file", "ingested_at", "events", reason.alias("reason")))
    good = judged.filter("reason IS NULL")
    # One slim row per file is numbered; the events follow by their place.
    slim = good.select(F.lit(0).alias("one"), "ingested_at", "source_file")
    order = ["ingested_at", "source_file"]
    ranged = range_blocks(slim, ["one"], order, scratch)
    numbered = with_rank(ranged, ["one"], order, F.col(RANGE), "file_no").select("source_file", "file_no")
    events = good.join(numbered, "source_file").select(
        F.xxhash64("source_file").alias("batch_id"), "ingested_at", "source_file", "file_no", F.posexplode("events").alias("place", "event"))
    arrival = arrival_number(F.col("place"), F.col("file_no"))
    return (events.select("batch_id", arrival.alias("arrival"), "ingested_at", "source_file", "event.*"),
            judged.filter("reason IS NOT NULL").select("source_file", "ingested_at", "reason"))


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited events as raw ``value`` text."""
    return spark.read.text(path)


_PARTITION_BITS = 20


def arrival_number(partition: Column, offset: Column) -> Column:
    """A unique number in the order of each partition; a number that would not be unique is an error."""
    fits = (partition < (1 << _PARTITION_BITS)) & (offset < (1 << 63 - _PARTITION_BITS))
    number = F.shiftleft(offset.cast("bigint"), _PARTITION_BITS).bitwiseOR(partition.cast("bigint"))
    return F.when(fits, number).otherwise(F.raise_error(F.lit("partition or offset out of range")).cast("bigint"))


def stream_topic(spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC) -> DataFrame:
    """Messages of a Kafka topic in arrival order per partition; needs the Kafka connector on the class path."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return messages.select(
        F.lit(None).cast("bigint").alias("batch_id"),
        arrival_number(F.col("partition"), F.col("offset")).alias("arrival"),
        F.col("timestamp").alias("ingested_at"),
        F.col("value").cast("string").alias("value"),
    )


def stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Envelope rows that arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(schemas.ENVELOPE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def is_run_event(value: Column) -> Column:
    """True for well-formed JSON objects whose ``eventType`` is present and not null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), "$.eventType", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def may_hold(value: Column, keys: list[str]) -> Column:
    """False only for JSON texts in which none of the keys can occur: a text without a backslash holds its keys as they are."""
    return reduce(Column.__or__, [F.contains(value, F.lit(key)) for key in ("\\", *keys)])


def keep_run_events(messages: DataFrame) -> DataFrame:
    return messages.filter(is_run_event(F.col("value")))


def parse_events(messages: DataFrame) -> DataFrame:
    """Envelope columns plus the wire record of each message."""
    wire = F.from_json("value", schemas.WIRE_EVENT_TYPE)
    return messages.withColumn("event", wire).drop("value").select("*", "event.*").drop("event")


def _empty_facets() -> Column:
    return F.create_map().cast(schemas.FACETS)


def _text(column: Column) -> Column:
    return trimmed(F.coalesce(column, F.lit("")))


def _datasets(items: Column) -> Column:
    """Datasets as they are stored: trimmed and split anew from their normalised URN.

    A name that does not survive the round trip through its URN is kept as given. Each
    step works on the fields of the one before, so no expression is repeated.
    """
    rest = ("facets", "input_facets", "output_facets")

    def given(item: Column) -> Column:
        return F.struct(
            _text(item["namespace"]).alias("namespace"),
            _text(item["name"]).alias("name"),
            F.coalesce(item["facets"], _empty_facets()).alias("facets"),
            F.coalesce(item["inputFacets"], _empty_facets()).alias("input_facets"),
            F.coalesce(item["outputFacets"], _empty_facets()).alias("output_facets"),
        )

    def with_urn(item: Column) -> Column:
        whole = (item["namespace"] != "") & (item["name"] != "")
        urn = F.when(whole, dataset_urn(item["namespace"], item["name"])).otherwise(F.lit(""))
        return F.struct(item["namespace"].alias("namespace"), item["name"].alias("name"), urn.alias("urn"),
                        *[item[f].alias(f) for f in rest])

    def split_again(item: Column) -> Column:
        usable = urn_error(item["urn"]).isNull()
        return F.struct(
            F.when(usable, urn_namespace(item["urn"])).otherwise(item["namespace"]).alias("namespace"),
            F.when(usable, urn_name(item["urn"])).otherwise(item["name"]).alias("name"),
            *[item[f].alias(f) for f in rest],
        )

    def final(item: Column) -> Column:
        return F.struct(
            item["namespace"].alias("namespace"), item["name"].alias("name"),
            dataset_urn(item["namespace"], item["name"]).alias("urn"), *[item[f].alias(f) for f in rest],
        )

    stored = items
    for step in (given, with_urn, split_again, final):
        stored = F.transform(stored, step)
    return F.coalesce(stored, F.array().cast(f"array<{schemas.STORED_DATASET}>"))


def _head_columns(events: DataFrame) -> dict[str, Column]:
    """The single fields of wire records: trimmed text and parsed times."""
    return {
        "event_type": _text(F.col("eventType")),
        "event_time_text": ef.event_time_text(F.col("eventTime")),
        "producer": _text(F.col("producer")),
        "schema_url": _text(F.col("schemaURL")),
        "run_id": _text(F.col("run.runId")),
        "job_namespace": _text(F.col("job.namespace")),
        "job_name": _text(F.col("job.name")),
    }


def _normalized(events: DataFrame, containers: dict[str, Column]) -> DataFrame:
    envelope = [c for c in ("batch_id", "arrival", "ingested_at", "source_file") if c in events.columns]
    columns = {**_head_columns(events), **containers}
    typed = events.select(*envelope, *[column.alias(name) for name, column in columns.items()])
    key = ef.idempotency_key(
        F.col("producer"), F.col("job_namespace"), F.col("job_name"), F.col("run_id"),
        F.coalesce("event_time_text", F.lit("0001-01-01T00:00:00Z")), F.col("event_type"),
    )
    return typed.withColumns({"event_time": ef.time_of(F.col("event_time_text")), "idempotency_key": key})


def normalize_events(events: DataFrame) -> DataFrame:
    """Wire records as typed rows: trimmed text, parsed times, canonical dataset names, no nulls in containers."""
    return _normalized(events, {
        "run_facets": F.coalesce("run.facets", _empty_facets()),
        "job_facets": F.coalesce("job.facets", _empty_facets()),
        "inputs": _datasets(F.col("inputs")),
        "outputs": _datasets(F.col("outputs")),
    })


def read_messages(messages: DataFrame) -> DataFrame:
    """From raw messages to normalised run events."""
    return normalize_events(parse_events(keep_run_events(messages)))


def read_heads(messages: DataFrame) -> DataFrame:
    """The single fields of ``read_messages``; facets and datasets are passed over, not parsed."""
    head = F.from_json("value", schemas.WIRE_HEAD_TYPE)
    heads = keep_run_events(messages).withColumn("event", head).drop("value").select("*", "event.*").drop("event")
    return _normalized(heads, {})
