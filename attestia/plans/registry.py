"""A decorator that registers a query and its oracle text in its module's tables."""

from __future__ import annotations

from attestia.functions.text import WHITE_SPACE


def trimmed(expression: str) -> str:
    """Oracle text that trims all white space."""
    return f"trim({expression}, '{WHITE_SPACE}')"


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle is not None:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query
