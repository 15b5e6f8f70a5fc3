"""Streaming forms against their batch twins."""

import threading

from pyspark.sql import functions as F

from larkspur.streaming import subscribe, watch

MESSAGES = "namespace string, queue string, message_id long, payload string"


def _write(spark, path, rows, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_subscribe_acks_and_nacks_every_message(spark, tmp_path):
    parts = [[("default", "q", i, "bad" if i % 3 == 0 else "ok") for i in range(n, n + 5)] for n in (0, 5, 10)]
    _write(spark, tmp_path / "in", parts, MESSAGES)
    stream = subscribe.message_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], MESSAGES).schema, files_per_batch=1)
    out = str(tmp_path / "out")

    def handler(batch):
        return batch.where("message_id <> 4").select("message_id", (F.col("payload") == "ok").alias("ok"))

    def sink(actions, number):
        actions.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = subscribe.subscribe(stream, handler, sink, str(tmp_path / "cp"))
    run.awaitTermination(90)
    got = {r.message_id: r.action for r in spark.read.parquet(out).collect()}
    assert got == {i: "nack_failure" if i % 3 == 0 or i == 4 else "ack" for i in range(15)}


def test_subscribe_with_state_joins_bound_state(spark, tmp_path):
    _write(spark, tmp_path / "in", [[("default", "q", 1, "a"), ("default", "q", 2, "b")]], MESSAGES)
    states = spark.createDataFrame([("default", "q/q/state/2", '{"n":1}')], "namespace string, key string, doc string")
    seen, lock = {}, threading.Lock()

    def handler(batch):
        with lock:
            seen.update({r.message_id: r.doc for r in batch.collect()})
        return batch.select("message_id", F.lit(True).alias("ok"))

    stream = subscribe.message_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], MESSAGES).schema)
    subscribe.subscribe_with_state(stream, states, handler, lambda a, n: a.count(), str(tmp_path / "cp")).awaitTermination(90)
    assert seen == {1: None, 2: '{"n":1}'}


OBSERVED = "namespace string, queue string, seq long, available boolean, head_message_id string"


def test_watch_stream_equals_batch(spark, tmp_path):
    rows = [("default", "q", 1, False, "a"), ("default", "q", 2, False, "a"), ("default", "q", 3, True, "b"), ("default", "r", 4, True, None), ("default", "q", 5, True, "b"), ("default", "r", 6, True, None), ("default", "q", 7, True, "c")]
    _write(spark, tmp_path / "in", [rows[:3], rows[3:5], rows[5:]], OBSERVED)
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = watch.watch(stream).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = sorted(r.seq for r in spark.table("watched").collect())
    assert got == sorted(r.seq for r in watch.changes(spark.createDataFrame(rows, OBSERVED)).collect()) == [1, 3, 4, 7]


def test_sse_events_skip_other_names(spark):
    lines = spark.createDataFrame([("queue_noise", "{}"), ("queue_watch", '{"available":true,"head_message_id":"msg-1","changed_at_unix":12345}'), (None, '{"available":false}')], "event string, data string")
    got = [(r.available, r.head_message_id, r.changed_at_unix) for r in watch.sse_events(lines).collect()]
    assert got == [(True, "msg-1", 12345), (False, None, None)]
