"""The demo warehouse: staging and mart models, and the checks that feed test results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stage_customers(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))


def stage_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("order_id"), F.col("customer").alias("customer_id"), "ordered_at", "store_id", "subtotal",
        "tax_paid", "order_total",
    )


def orders_mart(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, "customer_id", "left").select(
        "order_id", "customer_id", "customer_name", "ordered_at", "store_id", "subtotal", "tax_paid", "order_total"
    )


def customer_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("order_total").alias("total_amount"),
        F.min("ordered_at").alias("first_order_at"),
        F.max("ordered_at").alias("last_order_at"),
    )


def customers_mart(customers: DataFrame, orders: DataFrame) -> DataFrame:
    totals = customer_orders(orders)
    return customers.join(totals, "customer_id", "left").select(
        "customer_id",
        "customer_name",
        F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"),
        F.coalesce("total_amount", F.lit(0)).alias("total_amount"),
        "first_order_at",
        "last_order_at",
    )


def column_checks(table: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = ()) -> DataFrame:
    """(check_name, column_name, failures): values that occur twice, and missing values.

    Missing values take one pass together; each unique check groups by its column.
    """
    results = []
    if not_null:
        counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        results.append(_as_rows(counts, "not_null", not_null))
    for name in unique:
        repeated = table.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        results.append(_as_rows(repeated.agg(F.count_if(F.col("n") > 1).alias(name)), "unique", [name]))
    return reduce(DataFrame.unionByName, results)


def relationship_check(table: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """How many rows refer to a parent that does not exist."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    missing = table.filter(F.col(column).isNotNull()).select(column).join(keys, column, "left_anti")
    return _as_rows(missing.agg(F.count(F.lit(1)).alias(column)), "relationships", [column])


def _as_rows(counts: DataFrame, check: str, columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("failures")) for c in columns])
    return counts.select(F.explode(entries).alias("e")).select(F.lit(check).alias("check_name"), "e.*")


# The expectation suites of the demo, as (expectation, column, minimum, maximum).
CUSTOMER_SUITE = (
    ("expect_table_row_count_to_be_between", None, 1, 10000),
    ("expect_column_to_exist", "customer_id", None, None),
    ("expect_column_to_exist", "customer_name", None, None),
    ("expect_column_values_to_be_unique", "customer_id", None, None),
    ("expect_column_values_to_not_be_null", "customer_id", None, None),
    ("expect_column_values_to_not_be_null", "customer_name", None, None),
    ("expect_column_values_to_be_between", "order_count", 0, None),
    ("expect_column_values_to_be_between", "total_amount", 0, None),
)
ORDER_SUITE = (
    ("expect_table_row_count_to_be_between", None, 1, 100000),
    ("expect_column_to_exist", "order_id", None, None),
    ("expect_column_to_exist", "customer_id", None, None),
    ("expect_column_to_exist", "order_total", None, None),
    ("expect_column_values_to_be_unique", "order_id", None, None),
    ("expect_column_values_to_not_be_null", "order_id", None, None),
    ("expect_column_values_to_not_be_null", "customer_id", None, None),
    ("expect_column_values_to_not_be_null", "order_total", None, None),
    ("expect_column_values_to_be_between", "order_total", 0, None),
    ("expect_column_values_to_be_between", "subtotal", 0, None),
    ("expect_column_values_to_be_between", "tax_paid", 0, None),
)


def _between(value: Column, low: float | None, high: float | None) -> Column:
    bounds = [value >= low] if low is not None else []
    bounds += [value <= high] if high is not None else []
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def run_expectations(table: DataFrame, suite: Sequence[tuple]) -> DataFrame:
    """(test_name, column_name, status) for each expectation.

    Everything but uniqueness is one pass over the table. Missing columns fail, missing
    values do not count against a range.
    """
    def success(kind: str, column: str | None, low: float | None, high: float | None) -> Column | None:
        if kind == "expect_table_row_count_to_be_between":
            return _between(F.count(F.lit(1)), low, high)
        if kind == "expect_column_to_exist":
            return F.lit(column in table.columns)
        if column not in table.columns:
            return F.lit(False)
        if kind == "expect_column_values_to_not_be_null":
            return F.count_if(F.col(column).isNull()) == 0
        if kind == "expect_column_values_to_be_between":
            return F.count_if(~F.coalesce(_between(F.col(column), low, high), F.lit(True))) == 0
        if kind == "expect_column_values_to_be_unique":
            return None
        raise ValueError(f"unknown expectation {kind}")

    one_pass, results = [], []
    for kind, column, low, high in suite:
        passed = success(kind, column, low, high)
        if passed is None:
            duplicates = column_checks(table, unique=[column])
            results.append(
                duplicates.select(
                    F.lit(kind).alias("test_name"), "column_name", (F.col("failures") == 0).alias("success")
                )
            )
        else:
            one_pass.append((kind, column or "", passed))
    if one_pass:
        row = table.agg(*[passed.alias(f"r{i}") for i, (_, _, passed) in enumerate(one_pass)])
        entries = F.array(
            *[
                F.struct(
                    F.lit(kind).alias("test_name"), F.lit(column).alias("column_name"), F.col(f"r{i}").alias("success")
                )
                for i, (kind, column, _) in enumerate(one_pass)
            ]
        )
        results.insert(0, row.select(F.explode(entries).alias("e")).select("e.*"))
    rows = reduce(DataFrame.unionByName, results)
    return rows.select("test_name", "column_name", F.when(F.col("success"), "passed").otherwise("failed").alias("status"))
