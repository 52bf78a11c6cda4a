"""Incremental ingestion of death records (Structured Streaming)."""

from vitalrates.streaming.incremental import stream_base_cube  # noqa: F401
