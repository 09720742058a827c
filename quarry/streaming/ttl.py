"""Expiry: documents whose numeric field (epoch ms) has passed go, in batches, now and then."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def expires_in(seconds: float) -> int:
    return now_ms() + int(seconds * 1000)


def is_expired(value: float, now: int | None = None) -> bool:
    return value < (now_ms() if now is None else now)


def ttl_remaining(value: float, now: int | None = None) -> float:
    return max(0, value - (now_ms() if now is None else now))


def format_ttl(ms: float) -> str:
    for size, unit in ((86_400_000, "d"), (3_600_000, "h"), (60_000, "m")):
        if ms >= size:
            return f"{-(-int(ms) // size)}{unit}"
    return f"{-(-int(ms) // 1000)}s"


def expired(col: Column, now: int) -> Column:
    return F.coalesce(col <= F.lit(now), F.lit(False))


class TTLIndex:
    def __init__(self, collection, field: str, interval: float = 60.0, batch_size: int = 1000, on_purge: Callable[[int], None] | None = None):
        if interval < 5 or not 1 <= batch_size <= 10_000:
            raise QueryError("the interval is 5 s or more, the batch 1 to 10000")
        self.collection, self.field, self.interval, self.batch_size, self.on_purge = collection, field, interval, batch_size, on_purge
        self.total_deleted = self.cycle_count = 0
        self._stop: threading.Event | None = None

    @property
    def is_running(self) -> bool:
        return self._stop is not None

    def purge_now(self, now: int | None = None) -> int:
        """One rewrite of the collection takes at most batch_size documents, smallest ids first."""
        found = self.collection.find({self.field: {"$lte": now_ms() if now is None else now}}).select("_id").orderBy("_id").limit(self.batch_size)
        n = self.collection.delete_ids(found)
        self.total_deleted += n
        self.cycle_count += 1
        if n and self.on_purge:
            self.on_purge(n)
        return n

    def start(self) -> None:
        if self._stop is None:
            self._stop = stop = threading.Event()

            def work() -> None:
                while not stop.wait(self.interval):
                    self.purge_now()

            threading.Thread(target=work, daemon=True).start()

    def stop(self) -> None:
        if self._stop is not None:
            self._stop.set()
            self._stop = None
