"""Fields of run events: times, identity keys, producers, spec versions, parents, facets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from causeway.functions.urn import trimmed

# Run states and the ones that end a run.
RUN_STATES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT", "OTHER")
TERMINAL_STATES = ("COMPLETE", "FAIL", "ABORT")
# Test outcomes and the ones that open an incident.
TEST_STATUSES = ("passed", "failed", "error", "skipped", "warning")
INCIDENT_STATUSES = ("failed", "error")
# Fixed pattern: the address of the event specification.
SPEC_URL = r"\Ahttps://openlineage\.io/spec/(\d+-\d+-\d+)/OpenLineage\.json\z"

_TIME = r"\A\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?\z"
# Rewrites to RFC 3339 with nanoseconds and no trailing zeros, applied in this order.
_TIME_STEPS = (
    (r"\A(?<day>.{10}T)(?<hour>\d:)", "${day}0${hour}"),
    (r",", "."),
    (r"(\.\d{9})\d+", "$1"),
    (r"(\.\d*?)0+(?=\D|\z)", "$1"),
    (r"\.(?=\D|\z)", ""),
    (r"[+-]00:00\z", "Z"),
    (r"(?<!Z|[+-]\d{2}:\d{2})\z", "Z"),
)
# Whole seconds are rewritten without these steps: what is kept, and the offset if it is not UTC.
_WHOLE_SECONDS = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})?\z"
_VERSION = r"\Av?\d+\.\d+"


def event_time_text(text: Column) -> Column:
    """The time in RFC 3339 with its own offset and no trailing zeros; null when it is no time.

    A time without an offset is read as UTC.
    """
    raw = trimmed(text)
    written = raw
    for pattern, replacement in _TIME_STEPS:
        written = F.regexp_replace(written, pattern, replacement)
    offset = raw.substr(20, 6)
    whole = F.concat(raw.substr(1, 19), F.when(offset.isin("", "Z", "+00:00", "-00:00"), "Z").otherwise(offset))
    return F.when(raw.rlike(_WHOLE_SECONDS), whole).when(raw.rlike(_TIME), written)


def time_of(time_text: Column) -> Column:
    """Timestamp of a text made by ``event_time_text``; null for no time and for year one."""
    return F.nullif(F.try_to_timestamp(time_text), F.to_timestamp(F.lit("0001-01-01T00:00:00Z")))


def parse_event_time(text: Column) -> Column:
    return time_of(event_time_text(text))


def idempotency_key(producer: Column, namespace: Column, name: Column, run_id: Column, time_text: Column,
                    event_type: Column) -> Column:
    return F.sha2(F.concat(producer, namespace, name, run_id, time_text, event_type), 256)


def _made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once for each row, however often it is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(text: Column, beginning: str) -> Column:
    return F.when(text.startswith(beginning), F.substring(text, len(beginning) + 1, F.length(text))).otherwise(text)


def _url_parts(url: Column) -> Column:
    return F.split(_without(_without(url, "https://"), "http://"), "/", -1)


def _is_code_host(parts: Column) -> Column:
    return (F.size(parts) >= 3) & (parts[0] == "github.com")


def _after(parts: Column, marker: str) -> Column:
    """Position after the first ``marker`` segment, or 0 when nothing follows it."""
    found = F.array_position(parts, marker)
    return F.when((found > 0) & (found < F.size(parts)), found + 1).otherwise(F.lit(0)).cast("int")


def producer_name(url: Column) -> Column:
    return _made_once(_url_parts(url), lambda parts: _producer_name(url, parts))


def _producer_name(url: Column, parts: Column) -> Column:
    tool = _after(parts, "integration")
    named = F.when(tool > 0, F.try_element_at(parts, F.when(tool > 0, tool).otherwise(F.lit(1))))
    return (
        F.when(url == "", F.lit("unknown"))
        .when(_is_code_host(parts) & (named == "common"), F.try_element_at(parts, F.lit(-1)))
        .when(_is_code_host(parts) & named.isNotNull(), named)
        .when(_is_code_host(parts), F.try_element_at(parts, F.lit(3)))
        .otherwise(F.try_element_at(parts, F.lit(1)))
    )


def producer_version(url: Column) -> Column:
    return _made_once(_url_parts(url), _producer_version)


def _producer_version(parts: Column) -> Column:
    after_tree = _after(parts, "tree")
    # The segment after "tree" or the first later one that reads like a version.
    tail = F.slice(parts, F.when(after_tree > 0, after_tree).otherwise(F.lit(1)), F.greatest(F.size(parts), F.lit(1)))
    in_tail = F.try_element_at(F.filter(tail, lambda part: part.rlike(_VERSION)), F.lit(1))
    fourth = F.try_element_at(parts, F.lit(4))
    return F.coalesce(
        F.when(
            _is_code_host(parts),
            F.when(after_tree > 0, in_tail).otherwise(F.when(fourth.rlike(_VERSION), fourth)),
        ),
        F.lit(""),
    )


def is_spec_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1).rlike(SPEC_URL)


def spec_version(url: Column) -> Column:
    """The dotted version of a spec URL, "" for any other text."""
    return F.replace(F.regexp_extract(F.substring_index(url, "#", 1), SPEC_URL, 1), F.lit("-"), F.lit("."))


def _json_string(text: Column, path: str) -> Column:
    """The value at ``path`` when it is a JSON string, else null."""
    document = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(document, path, "string"))


def parent_run_id(run_facets: Column) -> Column:
    return F.coalesce(_json_string(F.try_element_at(run_facets, F.lit("parent")), "$.run.runId"), F.lit(""))


def root_parent_run_id(run_facets: Column) -> Column:
    return F.coalesce(_json_string(F.try_element_at(run_facets, F.lit("parent")), "$.root.run.runId"), F.lit(""))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps in one; an entry of ``second`` replaces the one of the same key."""
    kept = F.map_filter(first, lambda key, _: ~F.map_contains_key(second, key))
    return F.map_concat(kept, second)


def flat_facets(facets: Column, own_facets: Column, prefix: str) -> Column:
    """Common facets plus the input or output facets under a prefix."""
    return merge_maps(facets, F.transform_keys(own_facets, lambda key, _: F.concat(F.lit(prefix), key)))


def run_metadata(job_facets: Column, run_facets: Column, producer: Column, schema_url: Column) -> Column:
    return F.struct(
        job_facets.alias("job_facets"),
        run_facets.alias("run_facets"),
        producer.alias("producer"),
        schema_url.alias("schema_url"),
    )


def effective_job_status(status: Column, parent_status: Column) -> Column:
    """A run stuck before its end takes the status of a parent that has ended."""
    return F.when(stuck(status, parent_status), parent_status).otherwise(status)


def effective_completed_at(status: Column, parent_status: Column, completed: Column, parent_completed: Column) -> Column:
    return F.when(stuck(status, parent_status), parent_completed).otherwise(completed)


def stuck(status: Column, parent_status: Column) -> Column:
    return F.coalesce(status, F.lit("")).isin("RUNNING", "START", "OTHER", "") & F.coalesce(
        parent_status, F.lit("")
    ).isin(*TERMINAL_STATES)


def correlation_status(run_id: Column, is_orphan: Column) -> Column:
    return (
        F.when(F.coalesce(run_id, F.lit("")) == "", F.lit("unknown"))
        .when(F.coalesce(is_orphan, F.lit(False)), F.lit("orphan"))
        .otherwise(F.lit("correlated"))
    )


def assertion_status(assertion: Column) -> Column:
    """``passed`` only for the JSON literal true; anything else counts as a failure."""
    success = F.try_variant_get(assertion, "$.success", "variant")
    literal_true = (F.schema_of_variant(success) == "BOOLEAN") & F.try_variant_get(assertion, "$.success", "boolean")
    return F.when(literal_true, F.lit("passed")).otherwise(F.lit("failed"))


def variant_string(value: Column, path: str) -> Column:
    """The string at ``path`` of a variant; null when absent or of another type."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string"))


def resolution_or_open(status: Column) -> Column:
    return F.coalesce(status, F.lit("open"))
