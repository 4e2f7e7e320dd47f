"""Analysis of large collections of timed recordings as Spark tables.

Every table is keyed by ``media_id`` and measured in integer milliseconds.
"""
