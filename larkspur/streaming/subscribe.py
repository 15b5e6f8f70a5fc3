"""Queue subscriptions as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from larkspur.functions.scalars import queue_state_key
from larkspur.operators.consumers import auto_action

#: Writes one action table of a micro-batch: (actions, batch number).
ActionSink = Callable[[DataFrame, int], None]


def message_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Messages that arrive as Parquet files; a batch takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def subscribe(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], actions: ActionSink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``handler`` on every micro-batch and write one action for each message.

    The handler returns ``message_id, ok`` (and maybe ``action`` of its own).
    Messages it left out, and those with ok = false, are given back as
    failures; the rest are acknowledged. The batch number makes writes
    repeatable: a batch that runs again gives the same rows under the same
    number.
    """

    def each(batch: DataFrame, number: int) -> None:
        told = handler(batch)
        own = F.col("action") if "action" in told.columns else F.lit(None).cast("string")
        result = told.select("message_id", "ok", own.alias("_own"))
        done = batch.select("message_id").join(result, "message_id", "left")
        automatic = auto_action(F.coalesce("ok", F.lit(False)), F.col("_own").isNotNull())
        action = F.when(automatic == "none", F.col("_own")).otherwise(automatic)
        actions(done.select("message_id", action.alias("action"), F.lit(number).cast("long").alias("batch")), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def subscribe_with_state(stream: DataFrame, states: DataFrame, handler: Callable[[DataFrame], DataFrame], actions: ActionSink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """As :func:`subscribe`, with the state bound to each message joined to it (stream-static)."""
    keyed = stream.withColumn("state_key", queue_state_key(F.col("queue"), F.col("message_id").cast("string")))
    bound = states.withColumnRenamed("key", "state_key")
    return subscribe(keyed.join(bound, ["namespace", "state_key"], "left"), handler, actions, checkpoint, once)
