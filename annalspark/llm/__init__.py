"""Operators of a training-data pipeline: packing, privacy, deduplication, decontamination, filters, scoring.

Nothing outside this package imports it.  `queries.py` holds the thin queries registered by `__spark_entry__`.
"""
