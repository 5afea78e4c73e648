"""Maintenance that runs by itself: decay with pruning, and consolidation, each at its own interval."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..sources.store import MemoryStore

log = logging.getLogger(__name__)


class MaintenanceLoop:
    """One thread on the driver that starts jobs; an interval of None switches a task off.

    A task that finds the store busy is skipped until its next turn, and a
    failing one is logged and tried again then.
    """

    def __init__(self, store: MemoryStore, decay_every: float | None = 86_400, consolidate_every: float | None = 86_400, first_after: float = 300, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.store, self.now, self.first_after = store, now, first_after
        self.tasks = {"prune": (decay_every, lambda: store.prune(F.lit(now()))), "consolidate": (consolidate_every, lambda: store.consolidate(F.lit(now())))}
        self.done: dict[str, list[dict]] = {name: [] for name in self.tasks}
        self._stop = threading.Event()
        self._threads: list[threading.Thread] = []

    def start(self) -> None:
        if self._threads:
            return
        self._stop.clear()
        self._threads = [threading.Thread(target=self._run, args=(name, every, work), daemon=True) for name, (every, work) in self.tasks.items() if every is not None]
        for t in self._threads:
            t.start()

    def stop(self, timeout: float | None = None) -> None:
        """No further turns; waits for one that is running."""
        self._stop.set()
        for t in self._threads:
            t.join(timeout)
        self._threads = []

    def _run(self, name: str, every: float, work) -> None:
        wait = self.first_after
        while not self._stop.wait(wait):
            wait = every
            try:
                self.done[name].append(work())
            except Exception:  # noqa: BLE001  the next turn tries again
                log.exception("maintenance task %s failed", name)
