"""Operators of a training-data pipeline: scans, dedup, scoring, tokenising, formatting.

Nothing outside this subpackage imports it; `queries` holds the registered queries.
"""
