"""Operators for building training data: deduplication, search, packing, scans, filters, mixing, sharding.

Each module holds one operator, a function from DataFrames to DataFrames. `registry` binds them to the test tables.
"""
