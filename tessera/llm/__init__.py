"""Corpus operators: ten Spark jobs over documents and conversations.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
