"""Structured Streaming ingest and stream-side duplicate suppression."""
