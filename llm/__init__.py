"""Operators for training-data pipelines, their queries and the SQL that checks them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only where the folder exists.
"""
