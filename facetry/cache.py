"""Results of queries kept as Arrow tables: least recently used first out, by bytes and age."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from concurrent.futures import Future

import pyarrow as pa


class ResultCache:
    """At most ``max_bytes`` of tables, none older than ``ttl`` seconds.

    Callers that ask for one key at the same time share one computation and its outcome, an
    error included; errors aren't kept. A table of more than ``max_bytes`` is handed on, not kept."""

    def __init__(self, max_bytes: int = 256 << 20, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.max_bytes, self.ttl, self.clock = max_bytes, ttl, clock
        self.hits = self.misses = self.bytes = 0
        self._kept: OrderedDict[Hashable, tuple[float, pa.Table]] = OrderedDict()
        self._running: dict[Hashable, Future] = {}
        self._lock = threading.Lock()

    def get(self, key: Hashable, compute: Callable[[], pa.Table]) -> pa.Table:
        with self._lock:
            found = self._kept.get(key)
            if found and self.ttl is not None and self.clock() - found[0] > self.ttl:
                self._forget(key)
                found = None
            if found:
                self.hits += 1
                self._kept.move_to_end(key)
                return found[1]
            running = self._running.get(key)
            mine = running is None
            if mine:
                self.misses += 1
                running = self._running[key] = Future()
        if not mine:
            return running.result()
        try:
            table = compute()
        except BaseException as e:
            with self._lock:
                del self._running[key]
            running.set_exception(e)
            raise
        with self._lock:
            if self._running.get(key) is running:  # not cleared meanwhile
                del self._running[key]
                self._keep(key, table)
        running.set_result(table)
        return table

    def _keep(self, key: Hashable, table: pa.Table) -> None:
        if table.nbytes > self.max_bytes:
            return
        self._kept[key] = self.clock(), table
        self.bytes += table.nbytes
        while self.bytes > self.max_bytes:
            self._forget(next(iter(self._kept)))

    def _forget(self, key: Hashable) -> None:
        _, table = self._kept.pop(key)
        self.bytes -= table.nbytes

    def clear(self) -> None:
        """Forget all; computations under way are finished for those who wait, and not kept."""
        with self._lock:
            self._kept.clear()
            self._running.clear()
            self.bytes = 0
