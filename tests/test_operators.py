"""Behaviour that the queries' SQL does not show."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from larkspur.operators import attachments, catalog, leases, queues, state

VERSIONS = "namespace string, key string, version long, state_etag string, doc string, committed boolean, removed boolean, query_hidden boolean"


def versions(spark):
    rows = [("n", "a", 1, "e1", '{"v":1}', True, False, False), ("n", "a", 2, "e2", '{"v":2}', False, False, False), ("n", "b", 1, "e", "{}", True, True, False)]
    return spark.createDataFrame(rows, VERSIONS)


def test_public_and_private_views(spark):
    v = versions(spark)
    assert [r.version for r in state.get(v, "a", "n").collect()] == [1]
    assert [r.version for r in state.get(v, "a", "n", public=False).collect()] == [2]
    assert state.get(v, "b", "n").collect() == []


def test_write_conditions(spark):
    cases = [("a", 2, None, False), ("a", 1, None, True), ("a", None, "e2", False), ("a", None, "no", True), ("a", None, "", False), ("new", 0, None, False), ("new", None, "e", True), ("b", 1, None, False), ("b", 0, None, True), ("b", None, "e", True)]
    for key, version, tag, conflict in cases:
        write = spark.createDataFrame([("n", key, version, tag, "x")], WRITES)
        assert [r.conflict for r in state.check_writes(versions(spark), write).collect()] == [conflict], (key, version, tag)
    made = state.update(versions(spark), spark.createDataFrame([("n", "a", 2, None, "x")], WRITES)).first()
    assert (made.version, made.bytes) == (3, 1)


def test_one_write_of_a_batch_is_made_for_each_key(spark):
    writes = spark.createDataFrame([("n", "a", 1, None, "a"), ("n", "a", None, None, "c"), ("n", "a", 2, None, "b"), ("n", "a", 2, None, "b"), ("n", "b", None, None, "z")], WRITES)
    told = sorted((r.key, r.doc, r.conflict) for r in state.check_writes(versions(spark), writes).collect())
    assert told == [("a", "a", True), ("a", "b", False), ("a", "b", True), ("a", "c", True), ("b", "z", False)]
    made = state.update(versions(spark), writes).withColumn("committed", F.lit(True)).withColumn("removed", F.lit(False))
    assert sorted((r.key, r.version, r.doc) for r in made.collect()) == [("a", 3, "b"), ("b", 2, "z")]
    both = versions(spark).unionByName(made, allowMissingColumns=True)
    assert sorted((r.key, r.doc) for r in state.latest(both).collect()) == [("a", "b"), ("b", "z")]
    assert {r.key: r.removed for r in state.remove(versions(spark), writes.where("doc in ('b', 'z')")).collect()} == {"a": True, "b": False}


def test_a_released_lease_frees_its_key(spark):
    held = spark.createDataFrame([("n", "b", "l", "o", 4, 200), ("n", "c", "m", "o", 1, 200)], LEASES)
    asked = spark.createDataFrame([("n", "b", "q", 10, 3), ("n", "c", "q", 10, 4)], "namespace string, key string, owner string, ttl_seconds int, request_id long")
    after = leases.release_leases(held, held.where("key = 'b'").select("namespace", "key", "lease_id"), 100)
    assert [(r.key, r.fencing_token) for r in leases.acquire(after, asked, 100).collect()] == [("b", 5)]
    writes = held.select("namespace", "key", "lease_id", "fencing_token")
    assert [r.key for r in leases.fenced_writes(writes, after, 100).collect()] == ["c"]
    assert leases.fenced_writes(writes, after, 200).isEmpty()


WRITES = "namespace string, key string, if_version long, if_state_etag string, doc string"
LEASES = "namespace string, key string, lease_id string, owner string, fencing_token long, expires_at_unix long"


def test_update_under_leases_rolls_back_on_errors(spark):
    held = spark.createDataFrame([("n", "b", "l", "o", 4, 200)], LEASES)
    asked = spark.createDataFrame([("n", "a", "p", 10, 2), ("n", "a", "q", 10, 1), ("n", "b", "q", 10, 3)], "namespace string, key string, owner string, ttl_seconds int, request_id long")
    good = leases.acquire_for_update(held, versions(spark), asked, 100, lambda seen: seen.select("namespace", "key", F.lit("{}").alias("doc")))
    assert [(r.key, r.owner, r.fencing_token, r.expires_at_unix) for r in good.granted.collect()] == [("a", "q", 1, 110)]
    assert [r.expires_at_unix for r in good.released.collect()] == [100]
    assert [(r.key, r.version) for r in good.staged.collect()] == [("a", 3)] and not good.releases.first().rollback

    def fail(_seen):
        raise RuntimeError("handler")

    bad = leases.acquire_for_update(held, versions(spark), asked, 100, fail)
    assert isinstance(bad.error, RuntimeError) and bad.staged is None and bad.releases.first().rollback


def test_update_under_leases_works_on_versions_of_its_keys_only(spark):
    held = spark.createDataFrame([("n", "b", "l", "o", 4, 200), ("n", "c", "l", "o", 5, 100), ("n", "c", "m", "o", 4, None)], LEASES)
    asked = spark.createDataFrame([("n", k, "q", 10, i) for i, k in enumerate(["a", "b", "c", None])], "namespace string, key string, owner string, ttl_seconds int, request_id long")
    wanted = []

    def versions_of(keys):
        wanted.append(sorted(str(r.key) for r in keys.collect()))
        return state.of_keys(versions(spark), keys)

    def handler(seen):  # it also writes to a key that it was not granted
        other = spark.createDataFrame([("n", "b", "{}")], "namespace string, key string, doc string")
        return seen.select("namespace", "key", F.coalesce("doc", F.lit("none")).alias("doc")).union(other)

    for source in (versions_of, versions(spark)):
        made = leases.acquire_for_update(held, source, asked, 100, handler)
        assert sorted((str(r.key), r.version, r.doc) for r in made.staged.collect()) == [("None", 1, "none"), ("a", 3, '{"v":2}'), ("b", 2, "{}"), ("c", 1, "none")]
        assert sorted((str(r.key), r.fencing_token) for r in made.granted.collect()) == [("None", 1), ("a", 1), ("c", 6)]
    assert wanted == [["None", "a", "c"], ["None", "a", "b", "c"]]


def test_release_publishes_or_drops_staged_versions(spark):
    staged = versions(spark).withColumn("txn_id", F.col("version"))
    marks = lambda back: spark.createDataFrame([("n", "a", 2, back)], "namespace string, key string, txn_id long, rollback boolean")
    assert [r.version for r in state.latest(leases.release(staged, marks(False))).collect()] == [2]
    assert [r.version for r in state.latest(leases.release(staged, marks(True))).collect()] == [1]


def test_attach_outcomes(spark):
    schema = "namespace string, key string, name string, payload binary, id long"
    files = spark.createDataFrame([("n", "k", "a", bytearray(b"x"), 1), ("n", "k", "a", bytearray(b"y"), 2), ("n", "k", "b", bytearray(b"long"), 3), ("n", "k", "c", bytearray(b"z"), 4)], schema)
    stored = attachments.described(spark.createDataFrame([("n", "k", "c", bytearray(b"z"), 9)], schema))
    made = lambda **o: [r.outcome for r in attachments.attach(stored, files, F.col("id"), **o).sort("id").collect()]
    assert made() == ["stored", "stored", "stored", "noop"]
    assert made(prevent_overwrite=True) == ["stored", "exists", "stored", "exists"]
    assert made(max_bytes=3) == ["stored", "stored", "too_large", "noop"]
    with pytest.raises(ValueError):
        attachments.select(stored)


def test_queue_intents_and_order(spark):
    rows = spark.createDataFrame([("n", "q", i, bytearray(b"p"), 100 - i % 2) for i in range(4)], "namespace string, queue string, message_id long, payload binary, enqueued_at_unix long")
    messages = queues.enqueue(rows, ttl=50, max_attempts=1).withColumn("failure_attempts", F.lit(0))
    assert [r.message_id for r in queues.dequeue(messages, F.lit(120), 3).sort("rank").collect()] == [1, 3, 0]
    assert queues.dequeue(messages, F.lit(99), 3).count() == 2 and queues.dequeue(messages, F.lit(150), 3).count() == 0
    with pytest.raises(ValueError):
        queues.nack(messages, "later")


def test_leader_is_gone_after_release(spark):
    terms = spark.createDataFrame([("x", 1, 10, "acquire", 1), ("y", 2, 20, "acquire", 1), ("y", 2, 20, "release", 2)], "leader_id string, term long, expires_at long, event string, seq int")
    assert catalog.leader(terms).collect() == []
    assert catalog.leader(terms.where("event = 'acquire'")).first().leader_id == "y"


def test_entry_works_without_the_training_data_folder():
    code = "import sys; sys.modules['larkspur.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'state_latest' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=60).returncode == 0
