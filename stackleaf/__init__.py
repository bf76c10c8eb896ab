"""Spark-native corpus engine: segment, version, enrich and search document collections.

Every operator is a function from DataFrame to DataFrame (or a Column
expression), so a job is an ordinary Spark plan end to end.
"""
