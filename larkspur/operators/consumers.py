"""Consumer bookkeeping over event tables: delivery states, failure budgets, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import safe_token


#: Sequence numbers whose outcomes are sorted together.
BLOCK = 1 << 16


def delivery_state(events: DataFrame) -> DataFrame:
    """The state of every delivery after its events ``(delivery_id, kind, seq)``.

    open, then extender_stopped, terminal_in_progress, and terminal or, where a
    terminal call ended without an answer, indeterminate. A terminal state stays.
    """
    kind = lambda *k: F.bool_or(F.col("kind").isin(*k))
    told = events.groupBy("delivery_id").agg(
        kind("ack_ok", "nack_ok").alias("done"),
        kind("ack_lost", "nack_lost").alias("lost"),
        kind("ack", "nack").alias("asked"),
        kind("extender_stopped").alias("stopped"),
    )
    state = F.when(F.col("done"), "terminal").when(F.col("lost"), "indeterminate").when(F.col("asked"), "terminal_in_progress").when(F.col("stopped"), "extender_stopped").otherwise("open")
    return told.select("delivery_id", state.alias("state"))


def auto_action(handler_ok: Column, explicit_terminal: Column) -> Column:
    """What the runtime sends after a handler: nothing if the handler did, else ack or failure nack."""
    return F.when(explicit_terminal, "none").when(handler_ok, "ack").otherwise("nack_failure")


def failure_runs(outcomes: DataFrame) -> DataFrame:
    """``outcomes(consumer, seq, outcome)`` with ``failures`` in a row so far.

    A ``success`` resets the count, a ``delivery_error`` is reported as
    attempt 0 and counts nothing, a ``failure`` counts. A consumer may have any
    number of rows: they are counted within blocks of ``BLOCK`` numbers, and
    each block begins with what the blocks before it left.
    """
    resets, counts = (F.col("outcome") == "success").cast("int"), (F.col("outcome") == "failure").cast("int")
    rows = outcomes.withColumn("_block", F.coalesce(F.floor(F.col("seq") / BLOCK), F.lit(-(1 << 60))))
    order = Window.partitionBy("consumer", "_block").orderBy("seq")
    rows = rows.withColumn("_run", F.sum(resets).over(order))
    within = Window.partitionBy("consumer", "_block", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(counts).over(within))
    blocks = rows.groupBy("consumer", "_block").agg(F.max_by("_own", "seq").alias("_left"), F.max("_run").alias("_resets"))
    in_order = Window.partitionBy("consumer").orderBy("_block")
    blocks = blocks.withColumn("_stretch", F.sum((F.col("_resets") > 0).cast("int")).over(in_order))
    so_far = F.sum("_left").over(Window.partitionBy("consumer", "_stretch").orderBy("_block"))
    carried = blocks.withColumn("_sum", so_far).select("consumer", "_block", F.coalesce(F.lag("_sum").over(in_order), F.lit(0)).alias("_carried"))
    total = F.col("_own") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    both = rows.join(carried, ["consumer", "_block"])
    return both.withColumn("failures", F.when(F.col("outcome") == "delivery_error", F.lit(0)).otherwise(total).cast("long")).select(*outcomes.columns, "failures")


def stops(runs: DataFrame, max_failures: int) -> DataFrame:
    """For each consumer the first ``seq`` at which its failures exceed the budget; 0 is no budget."""
    beyond = F.col("failures") > max_failures if max_failures > 0 else F.lit(False)
    return runs.groupBy("consumer").agg(F.min(F.when(beyond, F.col("seq"))).alias("stopped_at"))


def owner_name(consumer: Column, host: str, pid: int, seq: Column) -> Column:
    """The default owner of a worker."""
    return F.concat_ws("-", F.lit("consumer"), safe_token(consumer), safe_token(F.lit(host)), F.lit(str(pid)), seq.cast("string"))
