"""The query catalogue and its SQL."""

from __future__ import annotations


def catalogue() -> dict:
    """All queries by name."""
    from . import files, queries  # noqa: F401  files adds its own

    return queries.QUERIES
