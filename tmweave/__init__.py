"""Localization-data analytics as Spark jobs."""
