"""Tokens of text search: lower-cased runs of letters and digits, two characters or more."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_IN = "a-z0-9\\x{00C0}-\\x{024F}"
_SPLIT = f"[^{_IN}]+"
_PY_SPLIT = re.compile("[^a-z0-9À-ɏ]+")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: F.length(t) >= 2)


def query_tokens(search: str) -> list[str]:
    return [t for t in _PY_SPLIT.split(search.lower()) if len(t) >= 2]


def matches_all(column: Column, listed: bool, search: str) -> Column:
    """Every token of the search is there; a search without tokens matches nothing, the empty search all.

    listed: column holds stored tokens; otherwise it is the text itself, in which a token stands between characters that no token has."""
    if search == "":
        return F.lit(True)
    wanted = sorted(set(query_tokens(search)))
    if not wanted:
        return F.lit(False)
    if listed:
        return reduce(lambda a, b: a & b, [F.array_contains(column, t) for t in wanted])
    low = F.lower(column)
    there = [F.contains(low, F.lit(t)) for t in wanted]  # cheap, and false for most
    alone = [low.rlike(f"(?<![{_IN}]){t}(?![{_IN}])") for t in wanted]
    return reduce(lambda a, b: a & b, [*there, *alone])
