"""Spark jobs for quantitative research and for training-corpus preparation."""
