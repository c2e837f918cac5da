"""Readers for run events, alias rules and seed files, and the keyed Parquet sink."""
