"""How much is admitted in a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class Quota:
    """Admits `most` of what comes within `seconds`, times being microseconds that don't decrease; what is refused doesn't count."""

    def __init__(self, most: int, seconds: int, before: Iterable[int] = ()):
        self.most, self.span, self.times = most, seconds * 1_000_000, deque(before)

    def __call__(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.span:
            self.times.popleft()
        ok = len(self.times) < self.most
        if ok:
            self.times.append(at)
        return ok
