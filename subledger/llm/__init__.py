"""Operators of a training-data pipeline: dedup, extraction, filtering, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
