"""Correlation health: coverage counts, orphan datasets and the rules that would connect them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions import event_fields as ef
from causeway.functions.urn import table_name, urn_name, urn_namespace
from causeway.plans.incidents import Tables


def tested_datasets(tables: Tables) -> DataFrame:
    """Per tested URN: number of results, last run of a test, a producer name."""
    return tables.tests.groupBy("dataset_urn").agg(
        F.count(F.lit(1)).alias("test_count"),
        F.max("executed_at").alias("last_seen"),
        F.coalesce(F.max("producer_name"), F.lit("")).alias("producer"),
    )


def produced_canonical(tables: Tables) -> DataFrame:
    outputs = tables.edges.filter(F.col("edge_type") == "output")
    return outputs.select(tables.canonical("dataset_urn").alias("canonical_urn")).distinct()


def unproduced(tables: Tables) -> DataFrame:
    """Tested datasets that no run produces under any name."""
    tested = tested_datasets(tables).withColumn("canonical_urn", tables.canonical("dataset_urn"))
    return tested.join(produced_canonical(tables), "canonical_urn", "left_anti").drop("canonical_urn")


def produced_urns(tables: Tables) -> DataFrame:
    """Each produced URN with one producer: the one of the smallest run id."""
    outputs = tables.edges.filter(F.col("edge_type") == "output").select("dataset_urn", "run_id")
    named = outputs.join(tables.runs.select("run_id", "producer_name"), "run_id", "left")
    return named.groupBy("dataset_urn").agg(
        F.coalesce(F.min_by("producer_name", "run_id"), F.lit("")).alias("producer")
    )


def produced_by_table_name(tables: Tables) -> DataFrame:
    """Per bare table name the first produced URN in URN order."""
    named = produced_urns(tables).withColumn("table_name", table_name(F.col("dataset_urn")))
    return named.filter(F.col("table_name") != "").groupBy("table_name").agg(
        F.min(F.struct(F.col("dataset_urn").alias("urn"), "producer")).alias("match")
    )


def orphans(tables: Tables) -> DataFrame:
    """Tested datasets without a producer, each with the produced dataset of the same table name, if any."""
    found = unproduced(tables).withColumn("table_name", table_name(F.col("dataset_urn")))
    joined = found.join(produced_by_table_name(tables), "table_name", "left")
    matched = F.col("match").isNotNull()
    return joined.select(
        "dataset_urn", "test_count", "last_seen", "producer",
        F.col("match.urn").alias("match_urn"),
        F.when(matched, F.lit(1.0)).alias("match_confidence"),
        F.when(matched, F.lit("exact_table_name")).alias("match_reason"),
        F.col("match.producer").alias("match_producer"),
    )


def ordered_orphans(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("test_count").desc(), F.col("dataset_urn"))


def matched_orphans(found: DataFrame) -> DataFrame:
    return found.filter(F.col("match_urn").isNotNull())


def unmatched_orphans(found: DataFrame) -> DataFrame:
    return found.filter(F.col("match_urn").isNull())


def orphan_rules(found: DataFrame) -> DataFrame:
    """Every orphan with the naming rule that would connect it: (dataset_urn, category, pattern, canonical), null if none would.

    Same name in another namespace gives a namespace rule. In one namespace, a name
    that is a dot suffix of the other gives a rule anchored on the leading segments,
    or an exact mapping when the orphan's name has one segment only.
    """
    named = found.select(
        "dataset_urn",
        urn_namespace(F.col("dataset_urn")).alias("own_ns"),
        urn_name(F.col("dataset_urn")).alias("own_name"),
        urn_namespace(F.col("match_urn")).alias("other_ns"),
        urn_name(F.col("match_urn")).alias("other_name"),
    )
    # No empty part and no lone slash: both URNs are well formed.
    usable = [F.col(f"{side}_ns") != "" for side in ("own", "other")]
    usable += [~F.col(f"{side}_name").isin("", "/") for side in ("own", "other")]
    parsed = named.withColumns(
        {"own": F.split("own_name", r"\.", -1), "other": F.split("other_name", r"\.", -1), "usable": reduce(lambda a, b: a & b, usable)}
    )
    gap = F.size("other") - F.size("own")
    suffix = F.when(gap > 0, F.slice("other", F.greatest(gap, F.lit(0)) + 1, F.size("own")) == F.col("own")).when(
        gap < 0, F.slice("own", F.greatest(-gap, F.lit(0)) + 1, F.size("other")) == F.col("other")
    )
    same_namespace = F.col("own_ns") == F.col("other_ns")
    category = (
        F.when(F.col("usable") & ~same_namespace & (F.col("own_name") == F.col("other_name")), "namespace")
        .when(F.col("usable") & same_namespace & suffix & (F.size("own") < 2), "exact")
        .when(F.col("usable") & same_namespace & suffix, "name")
    )

    def rule(side: str) -> Column:
        namespace = F.col(f"{side}_ns")
        head = F.array_join(F.slice(side, F.lit(1), F.size(side) - 1), ".")
        return (
            F.when(F.col("category") == "namespace", F.concat(namespace, F.lit("/{name}")))
            .when(F.col("category") == "exact", F.concat(namespace, F.lit("/"), F.col(f"{side}_name")))
            .when(F.col("category") == "name", F.concat(namespace, F.lit("/"), head, F.lit(".{table}")))
        )

    return parsed.withColumn("category", category).select(
        "dataset_urn", "category", rule("own").alias("pattern"), rule("other").alias("canonical"))


def suggested_rules(found: DataFrame) -> DataFrame:
    """One row per orphan that a naming rule would connect: (dataset_urn, category, pattern, canonical)."""
    return orphan_rules(found).filter(F.col("category").isNotNull())


def suggested_patterns(found: DataFrame) -> DataFrame:
    """Each suggested rule with the number of orphans it resolves; the orphans are in ``suggested_rules``."""
    return suggested_rules(found).groupBy("category", "pattern", "canonical").agg(
        F.count(F.lit(1)).alias("resolves_count")
    )


def ordered_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.col("resolves_count").desc(), F.col("pattern"), F.col("canonical"))


def health_stats(tables: Tables) -> DataFrame:
    """One row of distinct-dataset counts.

    Tests and output edges are reduced to one row of flags per canonical dataset in a
    single combining aggregation; every count is then a sum over those rows. No join
    and no distinct aggregate is needed.
    """
    tested = tables.tests.select(
        tables.canonical("dataset_urn").alias("urn"),
        F.lit(True).alias("is_tested"),
        F.col("status").isin(*ef.INCIDENT_STATUSES).alias("is_failed"),
        F.lit(False).alias("is_produced"),
    )
    made = tables.edges.filter(F.col("edge_type") == "output").select(
        tables.canonical("dataset_urn").alias("urn"),
        F.lit(False).alias("is_tested"),
        F.lit(False).alias("is_failed"),
        F.lit(True).alias("is_produced"),
    )
    flags = tested.unionByName(made).groupBy("urn").agg(
        F.bool_or("is_tested").alias("is_tested"),
        F.bool_or("is_failed").alias("is_failed"),
        F.bool_or("is_produced").alias("is_produced"),
    )
    return flags.agg(
        F.count_if("is_failed").alias("failed_tested"),
        F.count_if(F.col("is_failed") & F.col("is_produced")).alias("correlated_failed"),
        F.count_if("is_tested").alias("tested"),
        F.count_if("is_produced").alias("produced"),
        F.count_if(F.col("is_tested") & F.col("is_produced")).alias("correlated"),
    )


def correlation_rate(stats: DataFrame) -> DataFrame:
    """Share of failing datasets with a producer; 1.0 when nothing fails."""
    rate = F.when(F.col("failed_tested") == 0, F.lit(1.0)).otherwise(
        F.col("correlated_failed").cast("double") / F.col("failed_tested")
    )
    return stats.withColumn("correlation_rate", rate)


def health_report(tables: Tables) -> DataFrame:
    """The health summary in one row; orphans and patterns are reports of their own.

    Orphans are found once: grouped by the rule that would connect them, they give both counts.
    """
    by_rule = orphan_rules(orphans(tables)).groupBy("category", "pattern", "canonical").agg(F.count(F.lit(1)).alias("n"))
    counts = by_rule.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"), F.count("category").alias("rules")).alias("c"))
    found = counts.select("c").scalar()
    return correlation_rate(health_stats(tables)).select(
        "correlation_rate",
        F.col("tested").alias("total_datasets"),
        F.col("produced").alias("produced_datasets"),
        F.col("correlated").alias("correlated_datasets"),
        found["orphans"].alias("orphan_datasets"),
        found["rules"].alias("suggested_patterns"),
    )
