"""Operators of a large training-data pipeline, and the queries that apply them to whole tables."""
