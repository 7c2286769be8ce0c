"""All queries of the library with their SQL."""

from __future__ import annotations

from textquarry.plans import q_corpus, q_extract, q_text, q_tokens  # noqa: F401  they register their queries
from textquarry.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
