"""The registry that the query modules fill, and what a query gets to work with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.aliases import AliasResolver
from causeway.operators import resolution, tables
from causeway.operators.ingest import Ingested, ingest
from causeway.plans.incidents import Tables
from causeway.session import Scratch, measured_broadcasts, tune
from causeway.sources import events as event_source
from causeway.workload import given
from causeway.workload.sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# The landed messages and the tables ingested from them, written once per session and folder.
_LANDED: dict[tuple[str, str], DataFrame] = {}
_INGESTED: dict[tuple[str, str], Ingested] = {}


class Given:
    """The derived tables of one folder, and where a query puts its intermediate tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = measured_broadcasts(tune(spark)), folder

    @property
    def _key(self) -> tuple[str, str]:
        return self.spark.sparkContext.applicationId, self.folder

    @property
    def messages(self) -> DataFrame:
        if self._key not in _LANDED:
            _LANDED[self._key] = self.scratch.cut(given.derived(self.spark, self.folder, "messages"))
        return _LANDED[self._key]

    def __getitem__(self, name: str) -> DataFrame:
        return self.messages if name == "messages" else given.derived(self.spark, self.folder, name)

    @cached_property
    def tables(self) -> Tables:
        return given.lineage_tables(self.spark, self.folder)

    @cached_property
    def scratch(self) -> Scratch:
        return Scratch(self.spark)

    @cached_property
    def aliases(self) -> AliasResolver:
        return AliasResolver(given.ALIAS_RULES)

    @property
    def as_of(self):
        return given.as_of()

    @cached_property
    def events(self) -> DataFrame:
        return event_source.read_messages(self["messages"])

    @cached_property
    def asserting(self) -> DataFrame:
        """Those of ``events`` that can hold test outcomes; the others are not parsed."""
        return event_source.read_messages(self["messages"].filter(tables.may_hold_tests(F.col("value"))))

    @cached_property
    def heads(self) -> DataFrame:
        """The single fields of ``events``."""
        return event_source.read_heads(self["messages"])

    @property
    def ingested(self) -> Ingested:
        """The messages as stored tables, with no resolutions yet."""
        if self._key not in _INGESTED:
            _INGESTED[self._key] = self._ingest()
        return _INGESTED[self._key]

    def _ingest(self) -> Ingested:
        none = self.spark.createDataFrame(
            [],
            "test_result_id string, status string, resolved_by string, resolution_reason string, "
            "resolution_note string, resolved_by_test_result_id string, mute_expires_at timestamp, updated_at timestamp",
        )
        return ingest(self.events, self.scratch, none, self.aliases, heads=self.heads, asserting=self.asserting)

    @cached_property
    def requests(self) -> DataFrame:
        return resolution.check_requests(self["requests"])


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows over the named intermediate tables."""

    def register(build: Callable[[Given], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Given(spark, folder))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return build

    return register
