"""Restart policy of consumers, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the default policy.
IMMEDIATE, BASE_MS, FACTOR, CAP_MS = 3, 250, 2.0, 300_000


def delays(base: int = BASE_MS, factor: float = FACTOR, cap: int = CAP_MS) -> Iterator[int]:
    """Delays of the failures after the immediate ones, until they stay the same.

    Each is the one before times the factor, cut to whole milliseconds; where
    the factor does not make it grow, it is the cap.
    """
    delay = base
    while True:
        yield min(delay, cap)
        grown = delay * factor
        then = cap if grown <= delay or grown >= cap else int(grown)
        if then == delay or delay >= cap:
            return
        delay = then


def restart_delay_ms(failures: Column, immediate: int = IMMEDIATE, base: int = BASE_MS, factor: float = FACTOR, cap: int = CAP_MS) -> Column:
    """0 for the first failures, then the delays of :func:`delays`, the last of them for ever."""
    changes = sum(1 for _ in delays(base, factor, cap)) - 1
    steps = F.least(failures - immediate - 1, F.lit(changes)).cast("int")
    grow = lambda d: F.when((d * factor <= d) | (d * factor >= cap), F.lit(cap)).otherwise(F.floor(d * factor)).cast("long")
    grown = F.aggregate(F.sequence(F.lit(0), steps), F.lit(base).cast("long"), lambda d, k: F.when(k == 0, d).otherwise(grow(d)))
    return F.when(failures <= max(immediate, 0), F.lit(0).cast("long")).otherwise(F.least(grown, F.lit(cap).cast("long")))


def jittered(delay_ms: Column, jitter_ms: Column, uniform: Column, cap: int = CAP_MS) -> Column:
    """Delay plus or minus up to ``jitter_ms`` or itself (``uniform`` from 0 to 1), kept from 0 to the cap; no delay stays none."""
    reach = F.greatest(F.lit(0), F.least(jitter_ms, delay_ms))
    return F.greatest(F.lit(0), F.least(F.lit(cap), delay_ms + F.round((uniform * 2 - 1) * reach))).cast("long")


def is_fatal(code: Column, http_status: Column) -> Column:
    """Errors that no retry mends: bad requests, broken protocol, and 4xx except 408 and 429."""
    client_error = (http_status >= 400) & (http_status < 500) & ~http_status.isin(408, 429)
    return F.coalesce(code.isin("invalid", "protocol"), F.lit(False)) | F.coalesce(client_error, F.lit(False))


def extend_after_ms(visibility_seconds: Column) -> Column:
    """When to extend a delivery: half its visibility, from 250 ms to 30 s."""
    return F.greatest(F.lit(250), F.least(F.lit(30_000), (visibility_seconds * 500).cast("long"))).cast("long")


def subscribe_action(server_code: Column) -> Column:
    """What a subscriber does about a server's answer: try again, go to the next endpoint, end, or fail."""
    return F.when(server_code.isin("waiting", "cas_mismatch"), "retry").when(server_code == "node_passive", "next_endpoint").when(server_code == "cancelled", "end").otherwise("fail")
