"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``queries.py`` holds the queries that
``__spark_entry__.py`` registers when the package is present.
"""
