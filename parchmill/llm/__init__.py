"""Operators of a training-data pipeline over text and embedding tables.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
registers ``QUERIES`` and ``ORACLES`` of :mod:`parchmill.llm.registry`.
"""
