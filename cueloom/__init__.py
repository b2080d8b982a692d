"""Timed-text evidence analytics as Spark jobs."""
