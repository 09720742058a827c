"""Limits on names, filters, updates and pipelines, checked once when they are compiled."""

from __future__ import annotations

import re

from .errors import QueryError

# Fixed values.
MAX_DEPTH, MAX_KEYS, MAX_IN, MAX_REGEX, MAX_STAGES, MAX_EACH, MAX_ID, MAX_DOC_BYTES = 12, 64, 1000, 512, 32, 1000, 128, 16 * 1024 * 1024
RESERVED = ("__proto__", "constructor", "prototype")

_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")
# The shapes of patterns that are refused, a group that repeats inside and as a whole, and one counted repetition upon another.
_GROUP_REPEATED = re.compile(r"\([^)]*[+*][^)]*\)[+*]")
_COUNTED_TWICE = re.compile(r"\{[0-9]+,[0-9]*\}\{")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.match(name):
        raise QueryError(f"not a collection name: {name!r}")
    return name


def check_id(value: object) -> str:
    if not isinstance(value, str) or not 1 <= len(value) <= MAX_ID or "\0" in value:
        raise QueryError("an _id is a string of 1 to 128 characters without NUL")
    return value


def check_keys(value: object, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise QueryError("nested too deep")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str) or k in RESERVED:
                raise QueryError(f"key not allowed: {k!r}")
            check_keys(v, depth + 1)
    elif isinstance(value, (list, tuple)):
        for v in value:
            check_keys(v, depth + 1)


def check_regex(pattern: str) -> str:
    if len(pattern) > MAX_REGEX:
        raise QueryError("pattern too long")
    if _GROUP_REPEATED.search(pattern) or _COUNTED_TWICE.search(pattern):
        raise QueryError("a repetition of repetitions can take exponential time")
    return pattern


def check_filter(f: object, depth: int = 0) -> None:
    if not isinstance(f, dict):
        raise QueryError("a filter is an object")
    if depth > MAX_DEPTH:
        raise QueryError("filter nested too deep")
    if len(f) > MAX_KEYS:
        raise QueryError("too many keys in a filter")
    for k, v in f.items():
        if not isinstance(k, str) or k in RESERVED:
            raise QueryError(f"key not allowed: {k!r}")
        if k in ("$and", "$or", "$nor"):
            if not isinstance(v, (list, tuple)):
                raise QueryError(f"{k} takes a list")
            for x in v:
                check_filter(x, depth + 1)
        elif k in ("$in", "$nin"):
            if isinstance(v, (list, tuple)) and len(v) > MAX_IN:
                raise QueryError(f"{k} takes at most {MAX_IN} values")
        elif k == "$regex" and isinstance(v, str):
            check_regex(v)
        elif k == "$where":
            raise QueryError("$where is not allowed")
        elif isinstance(v, dict):
            check_filter(v, depth + 1)


def check_count(n: object, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or not 0 <= n < float("inf"):
        raise QueryError(f"{what} takes a finite number, 0 or more")
    return int(n)
