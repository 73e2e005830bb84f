"""Operators of a training-data pipeline: deduplication, filtering, scoring and token work.

Each module holds one operator with a general interface; ``queries`` holds the thin contract
queries over the driver tables.  Nothing else in the library imports this subpackage.
"""
