"""Lines of running jobs, handed to whoever listens: the last ones at once, then each as it comes.

This is for people who watch, and holds what they can watch: ``KEPT`` lines of a job, and ``WAITING`` events of a listener, of
which the oldest are dropped when it is too slow. The full record of a job is its ledger and its log table.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

#: Lines kept for each job, events that wait for a listener, and seconds until it is told that all is well.
KEPT, WAITING, QUIET = 10_000, 1_000, 15.0
END = "completed"


class Listener:
    """A bounded queue of (event, value) pairs that drops its oldest."""

    def __init__(self, waiting: int = WAITING):
        self._events: deque[tuple[str, object]] = deque(maxlen=waiting)
        self._changed = threading.Condition()

    def put(self, event: str, value: object) -> None:
        with self._changed:
            self._events.append((event, value))
            self._changed.notify()

    def events(self, quiet: float = QUIET) -> Iterator[tuple[str, object] | None]:
        """Events up to the end of the job; None whenever nothing came for ``quiet`` seconds."""
        while True:
            with self._changed:
                if not self._events:
                    self._changed.wait(quiet)
                found = self._events.popleft() if self._events else None
            yield found
            if found is not None and found[0] == END:
                return


class LogHub:
    def __init__(self, kept: int = KEPT):
        self._kept, self._lines, self._listeners, self._lock = kept, {}, {}, threading.Lock()

    def line(self, job: str, source: str, text: str) -> None:
        value = {"source": source, "line": text}
        with self._lock:
            self._lines.setdefault(job, deque(maxlen=self._kept)).append(value)
            for listener in self._listeners.get(job, ()):
                listener.put("log", value)

    def end(self, job: str, value: object = None) -> None:
        """The job is over: listeners are told and its lines are let go."""
        with self._lock:
            self._lines.pop(job, None)
            for listener in self._listeners.pop(job, ()):
                listener.put(END, value)

    def listen(self, job: str) -> tuple[list[dict], Listener]:
        """The lines so far, and a listener that gets each one after them."""
        with self._lock:
            listener = Listener()
            self._listeners.setdefault(job, set()).add(listener)
            return list(self._lines.get(job, ())), listener

    def leave(self, job: str, listener: Listener) -> None:
        with self._lock:
            self._listeners.get(job, set()).discard(listener)
