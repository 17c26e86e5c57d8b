"""Operators for large text corpora: tokenising, deduplication, filtering, sharding.

Every operator takes and returns Spark DataFrames and keeps general parameters; the thin ``opN_*`` queries of
:mod:`graphlens.llm.queries` apply them to the driver's tables and derive the digest columns.
"""
