"""Document ids: 12 hex digits of time in ms, 6 of the process, 6 of a counter."""

from __future__ import annotations

import itertools
import re
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

_PROCESS, _COUNTER = secrets.token_hex(3), itertools.count(secrets.randbelow(1 << 20))
_ID = re.compile("[0-9a-f]{24}")


def generate_id() -> str:
    return f"{time.time_ns() // 1_000_000:012x}{_PROCESS}{next(_COUNTER) & 0xFFFFFF:06x}"


def id_to_timestamp(value: str) -> int:
    """Milliseconds since the epoch."""
    return int(value[:12], 16)


def is_valid_id(value: object) -> bool:
    return isinstance(value, str) and bool(_ID.fullmatch(value))


def id_timestamp_column(col: Column) -> Column:
    return F.conv(F.substring(col, 1, 12), 16, 10).cast("long")
