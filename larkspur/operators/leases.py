"""Leases: exclusive, fenced, time-bounded ownership of keys, as batch operations.

Spark has no row locks, so a batch of requests is decided at once: of several
requests for a key the first (by request time, then id) wins, and writers
append what this module returns, one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import state

KEY = ("namespace", "key")


def live(leases: DataFrame, now: Column | int) -> DataFrame:
    """Leases whose expiry is later than now."""
    return leases.where(F.col("expires_at_unix") > (F.lit(now) if isinstance(now, int) else now))


def expired(leases: DataFrame, now: Column | int) -> DataFrame:
    """Leases whose expiry has come."""
    return leases.where(F.col("expires_at_unix") <= (F.lit(now) if isinstance(now, int) else now))


def current(leases: DataFrame) -> DataFrame:
    """The lease with the highest fencing token of every key."""
    rest = [c for c in leases.columns if c not in KEY]
    return leases.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col("fencing_token")).alias("_l")).select(*KEY, "_l.*")


def acquire(leases: DataFrame, requests: DataFrame, now: int, if_not_exists: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """Leases granted to ``requests(namespace, key, owner, ttl_seconds, request_id)``.

    Keys with a live lease are refused; ``if_not_exists`` also refuses keys of
    ``existing``. The fencing token is one above the key's highest so far.

    The leases are read once, for the last expiry and the highest token of each
    key: two numbers, which are combined before the shuffle and need no sort.
    """
    asked = requests
    if if_not_exists and existing is not None:
        asked = asked.join(existing.select(*KEY), list(KEY), "left_anti")
    first = asked.groupBy(*KEY).agg(F.min_by(F.struct("owner", "ttl_seconds", "request_id"), F.col("request_id")).alias("r"))
    held = leases.groupBy(*KEY).agg(F.max("fencing_token").alias("fence"), F.max("expires_at_unix").alias("until"))
    free = first.join(held, list(KEY), "left").where(F.col("until").isNull() | (F.col("until") <= F.lit(now)))
    return free.select(
        *KEY,
        "r.owner",
        F.sha2(F.concat_ws("/", *KEY, F.col("r.request_id").cast("string")), 256).alias("lease_id"),
        (F.coalesce("fence", F.lit(0)) + 1).cast("long").alias("fencing_token"),
        (F.lit(now) + F.col("r.ttl_seconds")).cast("long").alias("expires_at_unix"),
    )


def keepalive(leases: DataFrame, beats: DataFrame, now: int) -> DataFrame:
    """Live leases with a new expiry for each of ``beats(namespace, key, lease_id, ttl_seconds)``."""
    own = live(current(leases), now).join(beats, [*KEY, "lease_id"])
    return own.withColumn("expires_at_unix", (F.lit(now) + F.col("ttl_seconds")).cast("long")).select(*leases.columns)


def release(versions: DataFrame, releases: DataFrame) -> DataFrame:
    """Staged versions after ``releases(namespace, key, txn_id, rollback)``: published, or gone."""
    marks = releases.select(*KEY, "txn_id", F.col("rollback").alias("_back"))
    both = versions.join(marks, [*KEY, "txn_id"], "left")
    kept = both.where(F.col("committed") | ~F.coalesce(F.col("_back"), F.lit(False)))
    return kept.withColumn("committed", F.col("committed") | F.coalesce(~F.col("_back"), F.lit(False))).select(*versions.columns)


def release_leases(leases: DataFrame, releases: DataFrame, now: int) -> DataFrame:
    """Leases after ``releases(namespace, key, lease_id)``: one that is released expires now, so its key is free."""
    marks = releases.select(*KEY, "lease_id", F.lit(True).alias("_released")).distinct()
    until = F.when(F.col("_released"), F.least("expires_at_unix", F.lit(now).cast("long"))).otherwise(F.col("expires_at_unix"))
    return leases.join(marks, [*KEY, "lease_id"], "left").withColumn("expires_at_unix", until).select(*leases.columns)


def fenced_writes(writes: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Writes that carry the key's current lease, while it is live, and its fencing token."""
    return writes.join(live(current(leases), now).select(*KEY, "lease_id", "fencing_token"), [*KEY, "lease_id", "fencing_token"], "left_semi")


@dataclass(frozen=True)
class Update:
    """What an update under leases leaves: the leases, the same released, staged versions, and releases to write."""

    granted: DataFrame
    released: DataFrame
    staged: DataFrame | None
    releases: DataFrame
    error: Exception | None = None


def acquire_for_update(leases: DataFrame, versions: DataFrame | Callable[[DataFrame], DataFrame], requests: DataFrame, now: int, handler: Callable[[DataFrame], DataFrame]) -> Update:
    """Acquire, hand a private snapshot to ``handler``, stage what it returns, release.

    The handler gets ``namespace, key, doc, version, state_etag`` of the granted
    keys and returns ``namespace, key, doc``. Leases are released in any case;
    if the handler raises, with a rollback, and its error is in the result.

    Only versions of keys that need them are worked on: the granted keys for
    the snapshot, and those that the handler returns for what is staged. A table
    of versions is joined with these keys; versions that are first worked out
    come as a function that takes ``namespace, key`` and gives all versions of
    these keys.
    """
    versions_of = versions if callable(versions) else partial(state.of_keys, versions)
    granted = acquire(leases, requests, now)
    own = versions_of(granted.select(*KEY))
    own = own.select(*KEY, *(c for c in ("doc", "version", "state_etag", "removed") if c in own.columns))
    seen = granted.select(*KEY).join(state.latest(own, public=False).select(*KEY, "doc", "version", "state_etag"), list(KEY), "left")
    freed = granted.select(*KEY, F.col("lease_id").alias("txn_id"))
    after = release_leases(granted, granted, now)
    try:
        made = handler(seen)
    except Exception as error:  # the caller's code may raise anything
        return Update(granted, after, None, freed.withColumn("rollback", F.lit(True)), error)
    free = made.select(*KEY, "doc").withColumn("if_version", F.lit(None).cast("long")).withColumn("if_state_etag", F.lit(None).cast("string"))
    return Update(granted, after, state.update(versions_of(made.select(*KEY)), free), freed.withColumn("rollback", F.lit(False)))
