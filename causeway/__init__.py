"""Lineage and data-quality incident analytics as Spark DataFrame jobs."""
