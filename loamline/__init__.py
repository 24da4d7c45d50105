"""Corpus curation and evaluation as Spark DataFrame jobs."""
