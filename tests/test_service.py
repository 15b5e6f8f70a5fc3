"""The managed consumer, with stand-ins for streaming queries."""

import threading

import pytest

from larkspur.streaming.service import ConsumerService, FatalError, Policy

QUICK = Policy(base_ms=1, cap_ms=4)


class Query:
    def __init__(self, error=None, rows=0, wait=None):
        self.error, self.wait, self.stopped = error, wait, threading.Event()
        self.lastProgress = {"batchId": 0, "numInputRows": rows} if rows else None

    def awaitTermination(self):
        if self.wait:
            self.stopped.wait(10)
        if self.error:
            raise self.error

    def stop(self):
        self.stopped.set()


def service(*queries, **options):
    made = iter(queries)
    return ConsumerService(lambda: next(made), **({"policy": QUICK} | options))


def test_delays():
    assert [Policy().delay_ms(n) for n in range(1, 9)] == [0, 0, 0, 250, 500, 1000, 2000, 4000]
    assert Policy().delay_ms(1000) == 300_000


def test_restarts_until_the_query_ends():
    seen = []
    service(Query(OSError("a")), Query(OSError("b")), Query(), on_error=lambda e, n: seen.append((str(e), n)), on_start=lambda: seen.append("start"), on_stop=lambda: seen.append("stop")).run()
    assert seen == ["start", ("a", 1), ("b", 2), "stop"]


def test_progress_resets_the_count():
    seen = []
    service(Query(OSError("a")), Query(OSError("b"), rows=5), Query(OSError("c")), Query(), on_error=lambda e, n: seen.append(n)).run()
    assert seen == [1, 1, 2]


def test_budget_and_fatal_errors_end_the_service():
    with pytest.raises(OSError):
        service(*[Query(OSError("x")) for _ in range(9)], policy=Policy(max_failures=2, base_ms=1)).run()
    with pytest.raises(FatalError):
        service(Query(FatalError("bad request")), Query()).run()


def test_started_once_and_stopped():
    s = service(Query(wait=True))
    s.start()
    with pytest.raises(RuntimeError):
        s.start()
    assert s.wait(0.05) is False
    s.close()
    assert s.wait(1) is True
