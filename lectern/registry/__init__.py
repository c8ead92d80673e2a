"""Queries registered for the driver."""

from __future__ import annotations

import importlib

MODULES = ("search_terms", "vector_features", "title_queries", "passport_queries", "profile_queries", "product_queries", "search_queries", "feed_queries", "stream_queries")


def load():
    from lectern.registry.base import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"lectern.registry.{name}")
    return dict(QUERIES), dict(ORACLES)
