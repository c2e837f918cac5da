"""CSV seed files of the demo warehouse, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway import schemas


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_seed(spark, path, schemas.SEED_CUSTOMERS)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return read_seed(spark, path, schemas.SEED_ORDERS)
