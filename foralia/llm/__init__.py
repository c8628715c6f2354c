"""Operators for preparing training corpora. Nothing outside this folder and corpus_pipeline.py imports it."""
