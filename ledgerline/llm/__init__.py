"""Operators of a training-data pipeline: each module holds one operator with its own interface.

``registry`` binds them to the query names of ``__spark_entry__``.  Nothing else
in the library imports this subpackage.
"""
