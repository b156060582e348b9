"""Keeping an engine current from single change notices: a queue, a quiet period, bounded passes.

A notice marks its path as pending at once and is worked on later, when no further one has come for the quiet period
and no question is being answered.  A drain works in passes of a bounded number of notices, and ends after a bounded
number of passes or time; what is left stays pending and falls due again.  Every notice moves the epoch, so evidence
that was gathered under an earlier one can be told and dropped.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from cairn.streaming.changes import EVENTS

# Notices of a pass, passes and seconds of a drain.
NOTICES_A_PASS, PASSES, SECONDS = 64, 8, 1.0


class Maintenance:
    """``work`` takes a list of (path, event, seq); ``admits`` says which paths are followed."""

    def __init__(self, work: Callable[[list[tuple[str, str, int]]], None], admits: Callable[[str], bool] = bool, quiet_ms: int = 300, clock: Callable[[], float] = time.monotonic):
        self.work, self.admits, self.quiet, self.clock = work, admits, quiet_ms / 1000, clock
        self.queue: deque[tuple[str, str, int]] = deque()
        self.failures: list[str] = []
        self.epoch, self.due, self.leases = 0, None, 0

    @property
    def pending(self) -> list[str]:
        """Paths whose notices wait, sorted."""
        return sorted({path for path, _, _ in self.queue})

    def notify(self, event: str, path: str) -> bool:
        """Whether the notice counts: its kind is known and its path followed."""
        path = path.replace("\\", "/").removeprefix("./")
        if event not in EVENTS or path.startswith("/") or path[1:2] == ":" or ".." in path.split("/") or not self.admits(path):
            return False
        self.epoch += 1
        self.queue.append((path, event, self.epoch))
        self.due = self.clock() + self.quiet
        return True

    @contextmanager
    def lease(self) -> Iterator[int]:
        """While a question is answered nothing is drained on time; gives the epoch that the answer belongs to."""
        self.leases += 1
        try:
            yield self.epoch
        finally:
            self.leases -= 1

    def tick(self) -> bool:
        """Drains if that is due and nobody holds a lease; whether it did."""
        if self.due is None or self.leases or self.clock() < self.due:
            return False
        self.drain()
        return True

    def drain(self) -> int:
        """Works on what waits, within the bounds; the number of passes."""
        start, passes, self.due = self.clock(), 0, None
        while self.queue and passes < PASSES and (not passes or self.clock() - start < SECONDS):
            some = [self.queue.popleft() for _ in range(min(NOTICES_A_PASS, len(self.queue)))]
            passes += 1
            try:
                self.work(some)
            except Exception as e:
                self.failures.append(f"{type(e).__name__}: {e}"[:200])
        if self.queue:
            self.due = self.clock() + self.quiet
        return passes
