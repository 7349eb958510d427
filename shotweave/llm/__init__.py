"""Operators of a training-data pipeline: documents, pages and benchmarks in, filtered and encoded tables out."""
