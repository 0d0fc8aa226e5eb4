"""Registered queries over the given tables."""


def all_queries():
    """``(queries, oracles)`` of every plan module."""
    from veil.plans import matching, pages, runs, sources, streams, text  # noqa: F401
    from veil.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
