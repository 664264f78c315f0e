"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations


def norm_sql(column: str) -> str:
    """Insert normalisation of a column."""
    kept = rf"regexp_replace(lower({column}), '[^a-z0-9_,\s\p{{Z}}\x{{1c}}-\x{{1f}}-]', '', 'g')"
    return rf"left(trim(regexp_replace({kept}, '[\s\p{{Z}}\x{{1c}}-\x{{1f}}-]+', '_', 'g'), '_'), 100)"
