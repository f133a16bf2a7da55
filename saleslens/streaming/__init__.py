"""Structured Streaming entry points."""

from saleslens.streaming.ingest import stream_land_csv

__all__ = ["stream_land_csv"]
