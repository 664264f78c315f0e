"""Term normalisation as native column expressions.

Three rules exist and are kept apart: the insert rule, the scope rule (which
also drops commas) and the lookup rule.  Null stays null in all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_CHARS = 100

#: A value that the insert rule would leave as it is.
_NORMAL = rf"\A[a-z0-9,](?:[a-z0-9_,]{{0,{TERM_CHARS - 2}}}[a-z0-9,])?\z"
_PY_DROP = re.compile(r"[^a-z0-9_,\s-]")
_PY_JOIN = re.compile(r"[\s-]+")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def insert_norm(c: Column | str) -> Column:
    """Insert rule: lower case, delete all but ``a-z 0-9 _ , -`` and white space
    (of any script), join runs of white space and hyphens to ``_``, strip ``_``,
    first 100 characters.  A value without such characters becomes ``''``.

    >>> "  Caused\\u00a0By! " becomes "caused_by"

    Values that are normalised already, by far the most in a store, pass after
    one cheap match.
    """
    c = _col(c)
    kept = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9_,\s\x1c-\x1f-]", "")
    joined = F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f-]+", "_")
    return F.when(c.rlike(_NORMAL), c).otherwise(F.left(F.trim(joined, F.lit("_")), F.lit(TERM_CHARS)))


def scope_norm(c: Column | str) -> Column:
    """Scope rule: the insert rule without commas."""
    kept = F.regexp_replace(F.lower(_col(c)), r"(?U)[^a-z0-9_\s-]", "")
    return F.left(F.trim(F.regexp_replace(kept, r"(?U)[\s-]+", "_"), F.lit("_")), F.lit(TERM_CHARS))


def lookup_norm(c: Column | str) -> Column:
    """Lookup rule: lower case, blanks to ``_``, nothing else."""
    return F.replace(F.lower(_col(c)), F.lit(" "), F.lit("_"))


def insert_norm_py(value: str | None) -> str:
    """The insert rule for one Python value (Python workers); null gives ``''``."""
    if not value:
        return ""
    return _PY_JOIN.sub("_", _PY_DROP.sub("", value.strip().lower())).strip("_")[:TERM_CHARS]


def is_atomic(c: Column | str) -> Column:
    """True for a term that is not a comma-joined compound."""
    return ~F.contains(_col(c), F.lit(","))


def present(c: Column | str) -> Column:
    """True for a value that is neither null nor empty."""
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False))
