"""Operators of a training-data pipeline: scoring, near-duplicate joins, shards, filters and token files.

Every operator takes and returns DataFrames.  Nothing outside this subpackage imports it.
"""
