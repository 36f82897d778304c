"""Runnable plans: the query registry and the end-to-end flows."""


def load_queries():
    """All registered queries, by name."""
    from . import queries  # noqa: F401  (registers on import)
    from .registry import QUERIES
    return QUERIES
