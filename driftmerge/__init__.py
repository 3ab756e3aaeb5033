"""Conflict-free replicated tables, expressed as Spark DataFrame jobs."""
