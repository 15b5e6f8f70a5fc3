"""Message queues as tables: messages, and events that are folded into their state.

``messages(namespace, queue, message_id, enqueued_at_unix, ttl_seconds,
visibility_timeout_seconds, max_attempts, payload, ...)`` and ``events
(message_id, kind, at_unix, delay_seconds)`` with kinds ``deliver``, ``ack``,
``failure``, ``defer`` and ``extend``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import queue_state_key

QUEUE = ("namespace", "queue")


def enqueue(rows: DataFrame, delay_seconds: Column | int = 0, visibility: int = 30, ttl: int = 0, max_attempts: int = 0) -> DataFrame:
    """Messages from ``rows(namespace, queue, message_id, payload, enqueued_at_unix)``; 0 for ttl or attempts is no bound."""
    delay = F.lit(delay_seconds) if isinstance(delay_seconds, int) else delay_seconds
    return rows.select(
        "*",
        (F.col("enqueued_at_unix") + delay).cast("long").alias("not_visible_until_unix"),
        F.lit(visibility).cast("long").alias("visibility_timeout_seconds"),
        F.lit(ttl).cast("long").alias("ttl_seconds"),
        F.lit(max_attempts).alias("max_attempts"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def deliverable(now: Column) -> Column:
    """Visible, not expired, and with failures left."""
    fresh = (F.col("ttl_seconds") <= 0) | (now < F.col("enqueued_at_unix") + F.col("ttl_seconds"))
    budget = (F.col("max_attempts") <= 0) | (F.coalesce(F.col("failure_attempts"), F.lit(0)) < F.col("max_attempts"))
    return (now >= F.col("not_visible_until_unix")) & fresh & budget


def fold(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages with ``attempts``, ``failure_attempts`` and visibility after all events; acked ones are gone.

    The last event that sets visibility counts: a delivery hides for the
    message's timeout, failure and defer for their delay, extend for its own.
    """
    sets = F.col("kind").isin("deliver", "failure", "defer", "extend")
    told = events.groupBy("message_id").agg(
        F.count_if(F.col("kind") == "deliver").alias("attempts"),
        F.count_if(F.col("kind") == "failure").alias("failure_attempts"),
        F.bool_or(F.col("kind") == "ack").alias("_acked"),
        F.max(F.when(sets, F.struct("at_unix", "kind", "delay_seconds"))).alias("_last"),
    )
    held = F.coalesce(F.col("_last.delay_seconds"), F.when(F.col("_last.kind") == "deliver", F.col("visibility_timeout_seconds")).otherwise(F.lit(0)))
    both = messages.join(told, "message_id", "left").where(~F.coalesce(F.col("_acked"), F.lit(False)))
    return (
        both.withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))
        .withColumn("failure_attempts", F.coalesce("failure_attempts", F.lit(0).cast("long")))
        .withColumn("not_visible_until_unix", F.coalesce(F.col("_last.at_unix") + held, F.col("not_visible_until_unix")))
        .drop("_acked", "_last")
    )


def dequeue(messages: DataFrame, now: Column, page_size: int = 1, start_after: Column | None = None) -> DataFrame:
    """Up to ``page_size`` deliverable messages of every queue, oldest first, with their ``rank``."""
    rows = messages.where(deliverable(now))
    if start_after is not None:
        rows = rows.where(F.col("message_id") > start_after)
    order = Window.partitionBy(*QUEUE).orderBy("enqueued_at_unix", "message_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(page_size, 1))


def deliver(messages: DataFrame, consumers: DataFrame, now: int) -> DataFrame:
    """Deliveries of a batch of ``consumers(namespace, queue, consumer, page_size, request_id)``.

    The oldest deliverable messages of a queue go to its consumers in the order
    of their requests, each message to one of them. A delivery has a lease and
    hides its message for the visibility timeout; its row is also the event
    (``kind`` deliver) that :func:`fold` reads. ``messages`` are folded ones.
    """
    order = Window.partitionBy(*QUEUE).orderBy("request_id", "consumer")
    asked = consumers.withColumn("_until", F.sum("page_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = asked.select(*QUEUE, "consumer", "request_id", F.explode(F.sequence(F.col("_until") - F.col("page_size") + 1, F.col("_until"))).alias("rank"))
    first = Window.partitionBy(*QUEUE).orderBy("enqueued_at_unix", "message_id")
    wanted = asked.groupBy(*QUEUE).agg(F.max("_until").alias("_wanted"))
    ready = messages.where(deliverable(F.lit(now))).join(wanted, list(QUEUE))
    ranked = ready.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= F.col("_wanted"))
    return ranked.join(places, [*QUEUE, "rank"]).select(
        *QUEUE,
        "message_id",
        "consumer",
        F.sha2(F.concat_ws("/", *QUEUE, F.col("message_id").cast("string"), F.col("request_id").cast("string"), F.lit(str(now))), 256).alias("lease_id"),
        F.lit("deliver").alias("kind"),
        F.lit(now).cast("long").alias("at_unix"),
        F.col("visibility_timeout_seconds").alias("delay_seconds"),
        (F.lit(now) + F.col("visibility_timeout_seconds")).cast("long").alias("lease_expires_at_unix"),
        (F.coalesce("attempts", F.lit(0)) + 1).cast("long").alias("attempts"),
    )


def extend(deliveries: DataFrame, asks: DataFrame, now: int) -> DataFrame:
    """Live deliveries of ``asks(message_id, lease_id, extend_seconds)`` with their new expiry, as ``extend`` events."""
    live = deliveries.where(F.col("lease_expires_at_unix") > now).join(asks, ["message_id", "lease_id"])
    made = live.withColumn("kind", F.lit("extend")).withColumn("at_unix", F.lit(now).cast("long")).withColumn("delay_seconds", F.col("extend_seconds").cast("long"))
    return made.withColumn("lease_expires_at_unix", (F.lit(now) + F.col("extend_seconds")).cast("long")).select(*deliveries.columns)


def with_state(messages: DataFrame, states: DataFrame) -> DataFrame:
    """Messages with the state bound to them, if any (``states``: namespace, key, state columns)."""
    keyed = messages.withColumn("state_key", queue_state_key(F.col("queue"), F.col("message_id").cast("string")))
    bound = states.withColumnRenamed("key", "state_key")
    return keyed.join(bound, ["namespace", "state_key"], "left")


def ack(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """Messages that are not acknowledged."""
    return messages.join(acks.select("message_id").distinct(), "message_id", "left_anti")


def nack(events: DataFrame, intent: str, delay_seconds: int = 0) -> DataFrame:
    """Events for messages given back: ``failure`` (also if unspecified) uses budget, ``defer`` does not."""
    kinds = {"": "failure", "unspecified": "failure", "failure": "failure", "defer": "defer"}
    if intent not in kinds:
        raise ValueError(f"unknown intent {intent}")
    return events.select("message_id", F.lit(kinds[intent]).alias("kind"), "at_unix", F.lit(delay_seconds).cast("long").alias("delay_seconds"))


def stats(messages: DataFrame, now: Column, consumers: DataFrame | None = None) -> DataFrame:
    """One row for each queue: candidates, availability, consumers, and id, times and age of its head.

    ``consumers(namespace, queue, consumer, waiting)``: all that are connected.

    One aggregate with partial sums; the head is a ``min_by``, so a queue of
    any size sends one row from each task.
    """
    ready = deliverable(now)
    head = F.min(F.when(ready, F.struct("enqueued_at_unix", "message_id", "not_visible_until_unix")))
    told = messages.groupBy(*QUEUE).agg(F.count_if(ready).alias("pending_candidates"), head.alias("head"))
    if consumers is None:
        told = told.withColumn("waiting_consumers", F.lit(0).cast("long")).withColumn("total_consumers", F.lit(0).cast("long"))
    else:
        here = consumers.groupBy(*QUEUE).agg(F.count_if("waiting").alias("waiting_consumers"), F.count(F.lit(1)).alias("total_consumers"))
        told = told.join(here, list(QUEUE), "left").na.fill(0, ["waiting_consumers", "total_consumers"])
    return told.select(
        *QUEUE,
        "waiting_consumers",
        "total_consumers",
        "pending_candidates",
        (F.col("pending_candidates") > 0).alias("available"),
        F.col("head.message_id").alias("head_message_id"),
        F.col("head.enqueued_at_unix").alias("head_enqueued_at_unix"),
        F.col("head.not_visible_until_unix").alias("head_not_visible_until_unix"),
        (now - F.col("head.enqueued_at_unix")).alias("head_age_seconds"),
    )
