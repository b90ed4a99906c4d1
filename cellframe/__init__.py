"""Batch analytics for subscriber telemetry on Spark."""
