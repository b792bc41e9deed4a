"""Incident analytics as Spark DataFrame jobs."""
