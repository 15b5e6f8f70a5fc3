"""Queue watches: an event whenever availability or the head message changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUEUE = ("namespace", "queue")
#: Sequence numbers whose observations are sorted together.
BLOCK = 1 << 16


def changes(observations: DataFrame) -> DataFrame:
    """Observations ``(namespace, queue, seq, available, head_message_id)`` that differ from the one before; the first always does.

    A queue may have any number of rows: each is compared within its block of
    ``BLOCK`` numbers, and the first of a block with the last of the block before.
    """
    now = F.struct("available", "head_message_id")
    rows = observations.withColumn("_block", F.coalesce(F.floor(F.col("seq") / BLOCK), F.lit(-(1 << 60))))
    blocks = rows.groupBy(*QUEUE, "_block").agg(F.max_by(now, "seq").alias("_end"))
    carried = blocks.select(*QUEUE, "_block", F.lag("_end").over(Window.partitionBy(*QUEUE).orderBy("_block")).alias("_carried"))
    order = Window.partitionBy(*QUEUE, "_block").orderBy("seq")
    both = rows.withColumn("_before", F.lag(now).over(order)).join(carried, [*QUEUE, "_block"])
    before = F.coalesce("_before", "_carried")
    return both.where(before.isNull() | ~now.eqNullSafe(before)).drop("_before", "_carried", "_block")


def watch(observations: DataFrame, id_type: str = "string") -> DataFrame:
    """The streaming form of :func:`changes`: state is the last signature of each queue."""
    out = f"namespace string, queue string, seq long, available boolean, head_message_id {id_type}"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        kept = []
        for row in rows.itertuples(index=False):
            head = None if pd.isna(row.head_message_id) else str(row.head_message_id)
            signature = (bool(row.available), head)
            if last != signature:
                kept.append((*key, row.seq, row.available, row.head_message_id))
                last = signature
        state.update(last)
        yield pd.DataFrame(kept, columns=["namespace", "queue", "seq", "available", "head_message_id"])

    grouped = observations.select(*QUEUE, "seq", "available", "head_message_id").groupBy(*QUEUE)
    return grouped.applyInPandasWithState(step, out, "available boolean, head string", "append", GroupStateTimeout.NoTimeout)


def sse_events(lines: DataFrame) -> DataFrame:
    """Watch events out of server-sent events ``(event, data)``: those unnamed or named ``queue_watch``."""
    schema = "namespace string, queue string, available boolean, head_message_id string, changed_at_unix long, correlation_id string"
    own = lines.where(F.coalesce("event", F.lit("")).isin("", "queue_watch"))
    return own.select(F.from_json("data", schema).alias("e")).select("e.*")
