"""Change-feed processing on Spark DataFrames.

Subpackages: ``functions`` (column helpers), ``operators`` (filters, transforms,
routing, apply, encodings, lifecycle, metrics), ``sources`` (connectors,
snapshots, redo text), ``plans`` (DDL, query definitions) and ``streaming``.
"""
