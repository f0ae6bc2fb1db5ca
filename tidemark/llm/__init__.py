"""Operators for training-data pipelines, on top of Spark DataFrames.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
registered queries and ``__spark_entry__.py`` adds them when it can be imported.
"""
