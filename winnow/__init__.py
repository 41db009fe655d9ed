"""Winnow: candidate screening and evidence gathering as Spark DataFrame jobs."""
