"""Structured Streaming versions of the monitoring jobs."""
