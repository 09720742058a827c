"""Timings of operations: counts, errors, averages and nearest-rank percentiles of the last 10000, and a slow log."""

from __future__ import annotations

import math
import time
from collections import defaultdict, deque
from collections.abc import Callable

KEPT = 10_000


class Observability:
    """By collection and operation; a name without a collection stands under ''."""

    def __init__(self, slow_ms: float = 100.0):
        self.slow_ms = slow_ms
        self.reset()

    def reset(self) -> None:
        self._started = time.time()
        self._times = defaultdict(lambda: deque(maxlen=KEPT))
        self._count, self._errors, self._slow = defaultdict(int), defaultdict(int), deque(maxlen=100)

    def record(self, name: str, ms: float, ok: bool = True, collection: str = "") -> None:
        key = (collection, name)
        self._times[key].append(ms)
        self._count[key] += 1
        self._errors[key] += not ok
        if ms >= self.slow_ms:
            self._slow.append({"name": name, "collection": collection, "ms": ms, "at": time.time()})

    def measure(self, name: str, fn: Callable, collection: str = ""):
        start, ok = time.perf_counter(), False
        try:
            out = fn()
            ok = True
            return out
        finally:
            self.record(name, (time.perf_counter() - start) * 1000, ok, collection)

    def _told(self, keys: list[tuple[str, str]]) -> dict:
        s = sorted(t for k in keys for t in self._times[k])
        rank = {p: s[max(0, math.ceil(p / 100 * len(s)) - 1)] for p in (50, 95, 99)}
        return {"count": sum(self._count[k] for k in keys), "errors": sum(self._errors[k] for k in keys), "avg": sum(s) / len(s), "p50": rank[50], "p95": rank[95], "p99": rank[99]}

    def report(self) -> dict:
        """operations: each name over all collections; collections: each collection's operations."""
        names, places = sorted({k[1] for k in self._times}), sorted({k[0] for k in self._times})
        operations = {n: self._told([k for k in self._times if k[1] == n]) for n in names}
        collections = {c: {k[1]: self._told([k]) for k in sorted(self._times) if k[0] == c} for c in places}
        return {"uptime": time.time() - self._started, "operations": operations, "collections": collections, "slow": list(self._slow)}

    def to_prometheus(self) -> str:
        lines = []
        for c, operations in self.report()["collections"].items():
            for name, x in operations.items():
                on = f'collection="{c}",op="{name}"'
                lines += [f"quarry_operations_total{{{on}}} {x['count']}", f"quarry_errors_total{{{on}}} {x['errors']}"]
                lines += [f'quarry_latency_ms{{{on},quantile="{q}"}} {x[p]}' for q, p in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))]
        return "\n".join(lines) + "\n"


_ONE: Observability | None = None


def observability() -> Observability:
    global _ONE
    _ONE = _ONE or Observability()
    return _ONE
