"""A managed consumer: a streaming query that is started again by policy when it fails."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql.streaming.query import StreamingQuery

from larkspur.functions import backoff


class FatalError(Exception):
    """An error that no restart mends; raise it (or from it) in a handler."""


@dataclass(frozen=True)
class Policy:
    """Restarts: some at once, then growing delays up to a cap; 0 for ``max_failures`` is no bound."""

    max_failures: int = 0
    immediate: int = backoff.IMMEDIATE
    base_ms: int = backoff.BASE_MS
    factor: float = backoff.FACTOR
    cap_ms: int = backoff.CAP_MS

    def delay_ms(self, failures: int) -> int:
        if failures <= max(self.immediate, 0):
            return 0
        delay = 0
        for delay in islice(backoff.delays(self.base_ms, self.factor, self.cap_ms), failures - max(self.immediate, 0)):
            pass
        return delay


@dataclass
class ConsumerService:
    """Runs the query that ``start`` makes, from its checkpoint each time.

    ``start`` may be called again after a failure; a query that has committed
    a batch since it was started resets the count of failures. A service is
    started once; stopping it ends the query and its waits.
    """

    start_query: Callable[[], StreamingQuery]
    policy: Policy = field(default_factory=Policy)
    on_start: Callable[[], None] = lambda: None
    on_stop: Callable[[], None] = lambda: None
    on_error: Callable[[Exception, int], None] = lambda error, failures: None
    _thread: threading.Thread | None = field(default=None, init=False)
    _stopped: threading.Event = field(default_factory=threading.Event, init=False)
    _query: StreamingQuery | None = field(default=None, init=False)
    _error: Exception | None = field(default=None, init=False)

    def start(self) -> None:
        if self._thread is not None:
            raise RuntimeError("a service can be started once")
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def wait(self, timeout: float | None = None) -> bool:
        """Whether the service has ended; raises the error that ended it."""
        if self._thread is None:
            raise RuntimeError("the service was not started")
        self._thread.join(timeout)
        if self._error is not None:
            raise self._error
        return not self._thread.is_alive()

    def run(self) -> None:
        self.start()
        self.wait()

    def stop(self) -> None:
        self._stopped.set()
        if self._query is not None:
            self._query.stop()

    def close(self) -> None:
        self.stop()
        if self._thread is not None:
            self._thread.join()

    def _loop(self) -> None:
        self.on_start()
        failures = 0
        try:
            while not self._stopped.is_set():
                try:
                    self._query = self.start_query()
                    self._query.awaitTermination()
                    return
                except Exception as error:  # whatever ended the query is judged by the policy
                    if self._stopped.is_set():
                        return
                    failures = 1 if self._progressed() else failures + 1
                    self.on_error(error, failures)
                    if isinstance(error, FatalError) or "FatalError" in str(error) or 0 < self.policy.max_failures < failures:
                        self._error = error
                        return
                    self._stopped.wait(self.policy.delay_ms(failures) / 1000)
        finally:
            self.on_stop()

    def _progressed(self) -> bool:
        progress = self._query.lastProgress if self._query is not None else None
        return bool(progress) and progress["batchId"] >= 0 and progress["numInputRows"] > 0

