"""Corpus preparation and training-run analysis as Spark jobs."""
