"""Disproportionality screening of report data as Spark DataFrame jobs."""
