"""The engine's queries over the driver's tables, with SQL that gives the same rows.

Documents are ``events`` (namespace = event_type, key = events/<id>, doc =
props), messages are ``events`` too (queue = event_type), attachments are
``pages`` and backends are ``supplier`` rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import backoff, pointers, scalars, times
from larkspur.operators import attachments, catalog, consumers, leases, mutate, queues, state
from larkspur.operators import query as docs_query
from larkspur.plans.mutations import MutationError, Parser
from larkspur.shared import materialize, shared_path
from larkspur.sources import bytes_io
from larkspur.streaming import subscribe, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A fixed clock: 2024-01-15 00:00:00 UTC, and the same with nanoseconds for time literals.
NOW = 1_705_276_800
CLOCK = (1_700_000_000, 123_456_789)


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a time without zone, read as UTC whatever the session's zone."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000000) as bigint)")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents; those with a value below 1 are hidden."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("namespace"), F.format_string("events/%012d", "event_id").alias("key"), F.col("props").alias("doc"), "event_id", F.col("value"), F.lit(1).cast("long").alias("version"))


_DOCS = "(SELECT event_type AS namespace, printf('events/%012d', event_id) AS key, props AS doc, event_id, value FROM events)"
_K = "TRY_CAST(json_extract(doc, '/k') AS BIGINT)"


def _user_versions(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """Each user's events as versions of one document; error events are tombstones. ``keys`` limits the documents."""
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.lit("default").alias("namespace"), F.format_string("user/%d", "user_id").alias("key"), "ts", "event_id", F.col("props").alias("doc"), (F.col("event_type") == "error").alias("removed"), F.lit(True).alias("committed"), F.lit(False).alias("query_hidden"), _seconds().alias("updated_at_unix"))
    rows = rows if keys is None else state.of_keys(rows, keys)
    return state.history(rows, ["ts", "event_id"]).withColumn("state_etag", state.etag(F.col("doc")))


def _user_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each user's document, for queries that read it several times: versions are numbered once."""
    return materialize(state.newest(_user_versions(spark, sf_dir)), "user-heads")


_VERSIONS = """(SELECT printf('user/%d', user_id) AS key, event_id, props AS doc, event_type = 'error' AS removed, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at_unix,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"""
_LATEST = f"(SELECT * FROM {_VERSIONS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.lit("default").alias("namespace"), F.col("event_type").alias("queue"), F.col("event_id").alias("message_id"), F.col("user_id"), F.col("props").alias("payload"), _seconds().alias("enqueued_at_unix"))
    delay = (F.col("message_id") % 7 * 3600).cast("long")
    return queues.enqueue(rows, delay, visibility=30, ttl=30 * 86400, max_attempts=3)


_MESSAGES = """(SELECT event_type AS queue, event_id AS message_id, user_id, props AS payload, CAST(floor(epoch(ts)) AS BIGINT) AS enqueued_at_unix,
    CAST(floor(epoch(ts)) AS BIGINT) + event_id % 7 * 3600 AS not_visible_until_unix FROM events)"""
_READY = f"{NOW} >= not_visible_until_unix AND {NOW} < enqueued_at_unix + 2592000"


def _message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is delivered; by id some are acked, failed up to four times, deferred or extended."""
    m = _messages(spark, sf_dir).select("message_id", F.col("enqueued_at_unix").alias("at"))
    kinds = [
        ("deliver", F.lit(True), 1, None),
        ("ack", F.col("message_id") % 5 == 0, 2, None),
        ("failure", F.col("message_id") % 3 == 1, 3, 60),
        ("failure", F.col("message_id") % 6 == 1, 4, 120),
        ("failure", F.col("message_id") % 12 == 1, 5, 240),
        ("defer", F.col("message_id") % 4 == 2, 6, 600),
        ("extend", F.col("message_id") % 8 == 6, 7, 90),
    ]
    each = [F.when(holds, F.struct(F.lit(kind).alias("kind"), (F.col("at") + at).alias("at_unix"), F.lit(delay).cast("long").alias("delay_seconds"))) for kind, holds, at, delay in kinds]
    return m.select("message_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("message_id", "e.*")


# --- document queries

_EQ = {"eq": {"field": "/k", "value": 69}}


def _all_namespaces(df: DataFrame) -> DataFrame:
    return df.withColumn("namespace", F.lit("default"))


@query(f"SELECT key FROM {_DOCS} WHERE {_K} = 69")
def query_eq_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ, returns="keys"))


@query(f"SELECT key, doc FROM {_DOCS} WHERE {_K} = 69")
def query_eq_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ))


@query(f"SELECT key, doc FROM {_DOCS} WHERE namespace = 'view' AND {_K} = 7")
def query_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.run(_docs(spark, sf_dir), docs_query.Query({"k": 7}, namespace="view"))


@query(f"SELECT key, doc FROM {_DOCS} WHERE {_K} < 50 AND key > 'events/000000000100' ORDER BY key LIMIT 25")
def query_limit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = docs_query.Query({"range": {"field": "/k", "lt": 50}}, limit=25, cursor="events/000000000100")
    return docs_query.run(_all_namespaces(_docs(spark, sf_dir)), wanted)


@query(f"SELECT key, CAST({_K} AS VARCHAR) AS k FROM {_DOCS} WHERE {_K} = 69")
def query_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ, fields=("key", "/k")))


@query(f"SELECT key FROM {_DOCS} WHERE NOT (value < 1) AND {_K} >= 90")
def query_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = _all_namespaces(_docs(spark, sf_dir)).withColumn("query_hidden", F.col("value") < 1)
    return docs_query.run(hidden, docs_query.Query({"range": {"field": "/k", "gte": 90}}, returns="keys"))


@query(f"SELECT count(*) AS query_candidates, count(*) FILTER ({_K} = 69) AS query_matches, max(key) FILTER ({_K} = 69) AS cursor, 'keys' AS return_mode, CAST(NULL AS BIGINT) AS index_seq FROM {_DOCS}")
def query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.metadata(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ, returns="keys"))


@query(f"SELECT key, 1 AS version FROM {_DOCS} WHERE namespace = 'view' AND {_K} IS NOT NULL")
def query_namespace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_query.run(_docs(spark, sf_dir), docs_query.Query({"exists": {"field": "/k"}}, namespace="view", returns="compact")).withColumn("version", F.col("version").cast("int"))


@query(f"SELECT key, doc FROM {_DOCS} WHERE {_K} = 69")
def query_index_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, mapping = docs_query.build_index(_all_namespaces(_docs(spark, sf_dir)), [("/k", "bigint")])
    return docs_query.run(indexed, docs_query.Query(_EQ, engine="index"), mapping)


#: Documents whose field is a whole number, a fraction, a text, null or missing.
_MIXED = "(SELECT printf('events/%012d', event_id) AS key, event_id % 6 AS m, event_id % 10 AS n FROM events)"
_LEAVES = [
    ({"eq": {"field": "/k", "value": 1}}, "m IN (0, 5) AND n = 1"),
    ({"eq": {"field": "/k", "value": 1.0}}, "(m IN (0, 5) AND n = 1)"),
    ({"eq": {"field": "/k", "value": 2.5}}, "m = 1 AND n = 2"),
    ({"eq": {"field": "/k", "value": "1"}}, "m = 2 AND n = 1"),
    ({"range": {"field": "/k", "gt": 1.5, "lte": 7}}, "(m IN (0, 5) AND n BETWEEN 2 AND 7) OR (m = 1 AND n BETWEEN 2 AND 6) OR (m = 1 AND n = 1 AND false)"),
    ({"prefix": {"field": "/k", "value": "1"}}, "m = 2 AND n = 1"),
    ({"eq": {"field": "/k", "value": None}}, "m = 3"),
    ({"not": {"exists": {"field": "/k"}}}, "m = 4"),
]


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = F.col("event_id") % 6, (F.col("event_id") % 10).cast("string")
    value = F.when(m.isin(0, 5), n).when(m == 1, F.concat(n, F.lit(".5"))).when(m == 2, F.concat(F.lit('"'), n, F.lit('"'))).when(m == 3, F.lit("null"))
    doc = F.coalesce(F.concat(F.lit('{"k":'), value, F.lit("}")), F.lit("{}"))
    return _docs(spark, sf_dir).select(F.lit("default").alias("namespace"), "key", doc.alias("doc"))


@query(" UNION ALL ".join(f"SELECT {i} AS leaf, kind, count(*) FILTER ({sql}) AS n, max(key) FILTER ({sql}) AS last FROM {_MIXED}, (VALUES ('bigint'), ('double'), ('string'), ('boolean')) t(kind) GROUP BY kind" for i, (_, sql) in enumerate(_LEAVES)))
def query_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf over a stored index of every type: the rows of a scan, and the flush that the index holds."""
    docs, found = _mixed(spark, sf_dir), []
    for kind in ("bigint", "double", "string", "boolean"):
        indexed, mapping = docs_query.build_index(docs, [("/k", kind)])
        path = shared_path(spark, f"index-{kind}")
        docs_query.write_index(indexed, path, index_seq=7)
        told = docs_query.metadata_each(spark.read.parquet(path), [docs_query.Query(leaf, engine="index") for leaf, _ in _LEAVES], mapping).where("index_seq = 7")
        found.append(told.select(F.col("query").alias("leaf"), F.lit(kind).alias("kind"), F.col("query_matches").alias("n"), F.col("cursor").alias("last")))
    return reduce(DataFrame.union, found)


@query(f"SELECT key FROM {_DOCS} WHERE {_K} = 69 ORDER BY key LIMIT 40")
def query_stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one page, handed to a callback one by one."""
    page, got = docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ, returns="keys", limit=40)), []
    docs_query.stream_keys(page, lambda: None, got.append, lambda: None)
    return spark.createDataFrame([(k,) for k in got], "key string")


@query(f"SELECT string_agg(key, ',' ORDER BY key) AS keys, max(key) AS cursor FROM (SELECT key FROM {_DOCS} WHERE {_K} = 69 ORDER BY key LIMIT 40)")
def query_keys_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(_EQ, returns="keys", limit=40))
    return docs_query.keys_envelope(page).select(F.array_join("keys", ",").alias("keys"), "cursor")


@query(f"SELECT key FROM {_DOCS} WHERE ({_K} IN (1, 2, 3) OR {_K} = 69) AND NOT {_K} = 2")
def query_boolean_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"and": [{"or": [{"in": {"field": "/k", "values": [1, 2, 3]}}, _EQ]}, {"not": {"eq": {"field": "/k", "value": 2}}}]}
    return docs_query.run(_all_namespaces(_docs(spark, sf_dir)), docs_query.Query(tree, returns="keys"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def query_structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.lit("default").alias("namespace"), F.format_string("orders/%d", "o_orderkey").alias("key"), F.col("o_orderkey"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("doc"))
    tree = {"and": [{"eq": {"field": "/status", "value": "F"}}, {"prefix": {"field": "/priority", "value": "1"}}]}
    return docs_query.candidates(o, docs_query.Query(tree)).select("o_orderkey")


# --- mutations


def _mutated(spark: SparkSession, sf_dir: str, *expressions: str, files: dict[str, bytes] | None = None) -> DataFrame:
    plan = Parser(CLOCK, (files or {}).__getitem__).plan(list(expressions))
    return mutate.mutate(_docs(spark, sf_dir).select("event_id", "doc"), plan)


def _mutate_query(name: str, doc_sql: str, *expressions: str, files: dict[str, bytes] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _mutated(spark, sf_dir, *expressions, files=files)

    run.__name__ = name
    query(f"SELECT event_id, {doc_sql} AS doc FROM {_DOCS}")(run)


_mutate_query("mutate_increment", f"concat('{{\"k\":', {_K} + 1, '}}')", "/k++")
_mutate_query("mutate_decrement", f"concat('{{\"k\":', {_K} - 1, '}}')", "/k--")
_mutate_query("mutate_add_number", f"concat('{{\"k\":', {_K} + 5, '}}')", "/k=5")
_mutate_query("mutate_set_literal", f"concat('{{\"k\":', {_K}, ',\"s\":\"x\"}}')", '/s="x"')
_mutate_query("mutate_set_quoted_number", "'{\"k\":7}'", '/k="7"')
_mutate_query("mutate_remove", "'{}'", "rm:/k")
_mutate_query("mutate_remove_missing", "doc", "rm:/optional/field")
_mutate_query("mutate_create_path", f"concat('{{\"k\":', {_K}, ',\"stats\":{{\"views\":1}}}}')", "/stats/views++")
_mutate_query("mutate_time_offset", f"concat('{{\"k\":', {_K}, ',\"ts\":\"2024-01-02T00:34:05Z\"}}')", "time:/ts=2024-01-02T03:04:05+02:30")
_mutate_query("mutate_time_now", f"concat('{{\"k\":', {_K}, ',\"ts\":\"2023-11-14T22:13:20.123456789Z\"}}')", "time:/ts=NOW")
_mutate_query("mutate_base64_file", f"concat('{{\"k\":', {_K}, ',\"b\":\"AAECYQ==\"}}')", "base64file:/b=blob.bin", files={"blob.bin": b"\x00\x01\x02a"})
_mutate_query("mutate_text_file", f"concat('{{\"k\":', {_K}, ',\"t\":\"hello\"}}')", "textfile:/t=a.txt", files={"a.txt": b"hello"})
_mutate_query("mutate_braces", f"concat('{{\"k\":', {_K}, ',\"a\":{{\"b\":\"x\",\"c\":1}}}}')", "/a{/b=x,/c++}")
_mutate_query("mutate_sequence", f"concat('{{\"k\":', {_K} + 3, ',\"flag\":true}}')", "/k++", "/k=2", "/flag=true", "rm:/none")


@query(f"SELECT event_id, CASE WHEN {_K} >= 0 THEN 'increment target is not numeric' END AS mutation_error FROM {_DOCS}")
def mutate_type_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _docs(spark, sf_dir).select("event_id", F.regexp_replace("doc", r"(\d+)", '"$1"').alias("doc"))
    return mutate.mutate(texts, Parser().plan(["/k++"]), strict=False).select("event_id", "mutation_error")


@query(f"SELECT event_id, concat('{{\"a\":[1,{{\"n\":', {_K} + 1, '}}]}}') AS doc FROM {_DOCS}")
def mutate_array_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = _docs(spark, sf_dir).select("event_id", F.regexp_replace("doc", r".*?(\d+).*", '{"a":[1,{"n":$1},3]}').alias("doc"))
    return mutate.mutate(arrays, Parser().plan(["/a/1/n++", "rm:/a/2"]))


@query("SELECT '/k=0' AS expression, 'increment mutation requires non-zero delta' AS error UNION ALL SELECT '/k=0x0p1', 'increment mutation requires non-zero delta' UNION ALL SELECT '/k=\"0\"', NULL UNION ALL SELECT '/k=-0.5', NULL")
def mutate_zero_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    def error(expression: str) -> str | None:
        try:
            Parser().plan([expression])
        except MutationError as e:
            return str(e)
        return None

    return spark.createDataFrame([(e, error(e)) for e in ("/k=0", "/k=0x0p1", '/k="0"', "/k=-0.5")], "expression string, error string")


_mutate_query("mutate_file_auto", f"concat('{{\"k\":', {_K}, ',\"t\":\"hi\",\"b\":\"AP8=\"}}')", "file:/t=a.txt", "file:/b=b.bin", files={"a.txt": b"hi", "b.bin": b"\x00\xff"})


@query(f"SELECT event_id, concat('{{\"k\":', {_K}, ',\"t\":\"below\"}}') AS doc FROM {_DOCS}")
def mutate_path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is named from a base folder, read once on the driver when the plan is made."""
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "sub").mkdir()
        (Path(folder) / "sub" / "note.txt").write_text("below")
        plan = Parser(base_dir=folder).plan(["textfile:/t=sub/../sub/note.txt"])
    return mutate.mutate(_docs(spark, sf_dir).select("event_id", "doc"), plan)


# --- state


@query(f"SELECT key, version, doc FROM {_LATEST} WHERE NOT removed")
def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(_user_versions(spark, sf_dir)).select("key", "version", "doc")


@query(f"SELECT key, version, event_id FROM {_VERSIONS}")
def state_version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_versions(spark, sf_dir).select("key", "version", "event_id")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write for each customer: versions expected by number, text or neither."""
    c = _table(spark, sf_dir, "customer")
    return c.select(F.lit("default").alias("namespace"), F.format_string("user/%d", "c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 60).when(F.col("c_custkey") % 3 == 1, F.lit(0)).cast("long").alias("if_version"), F.when(F.col("c_custkey") % 5 == 0, "").alias("if_state_etag"), F.to_json(F.struct("c_custkey")).alias("doc"))


_WRITES = "(SELECT printf('user/%d', c_custkey) AS key, c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 60 WHEN 1 THEN 0 END AS if_version FROM customer)"
_CHECKED = f"(SELECT w.*, coalesce(l.version, 0) AS current_version, coalesce(NOT l.removed, false) AS there, coalesce(w.if_version <> coalesce(l.version, 0), false) AS conflict FROM {_WRITES} w LEFT JOIN {_LATEST} l USING (key))"


@query(f"SELECT key, current_version, conflict FROM {_CHECKED}")
def state_cas_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.check_writes(_user_versions(spark, sf_dir), _writes(spark, sf_dir)).select("key", "current_version", "conflict")


@query(f"SELECT key, current_version + 1 AS version, CAST(length(printf('{{\"c_custkey\":%d}}', c_custkey)) AS BIGINT) AS bytes, sha256(printf('{{\"c_custkey\":%d}}', c_custkey)) AS state_etag FROM {_CHECKED} WHERE NOT conflict")
def state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.update(_user_versions(spark, sf_dir), _writes(spark, sf_dir)).select("key", "version", "bytes", "state_etag")


@query(f"SELECT key, current_version + 1 AS version, there AS removed FROM {_CHECKED} WHERE NOT conflict")
def state_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.remove(_user_versions(spark, sf_dir), _writes(spark, sf_dir)).select("key", "version", "removed")


@query(f"SELECT key, max(version) + 1 AS version, 'back' AS doc FROM {_VERSIONS} GROUP BY key HAVING arg_max(removed, version)")
def state_write_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to removed keys, read back: they stand above the tombstone."""
    versions = _user_heads(spark, sf_dir)
    writes = versions.where("removed").select("namespace", "key", F.lit(None).cast("long").alias("if_version"), F.lit(None).cast("string").alias("if_state_etag"), F.lit("back").alias("doc"))
    made = state.update(versions, writes).withColumn("removed", F.lit(False)).withColumn("committed", F.lit(True))
    both = versions.unionByName(made, allowMissingColumns=True)
    return state.latest(both).join(writes.select("namespace", "key"), ["namespace", "key"], "left_semi").select("key", "version", "doc")


@query(
    f"""SELECT key, c_custkey, coalesce(l.version, 0) + 1 AS version, row_number() OVER (PARTITION BY key ORDER BY c_custkey) > 1 AS conflict
    FROM (SELECT printf('user/%d', c_custkey % 100) AS key, c_custkey FROM customer) LEFT JOIN (SELECT key, max(version) AS version FROM {_VERSIONS} GROUP BY key) l USING (key)"""
)
def state_batch_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many writes to one key in a batch: the first by id is made."""
    c = _table(spark, sf_dir, "customer")
    writes = c.select(F.lit("default").alias("namespace"), F.format_string("user/%d", F.col("c_custkey") % 100).alias("key"), F.lit(None).cast("long").alias("if_version"), F.lit("").alias("if_state_etag"), F.col("c_custkey").alias("write_id"), F.lit("{}").alias("doc"))
    checked = state.check_writes(_user_versions(spark, sf_dir), writes)
    return checked.select("key", F.col("write_id").alias("c_custkey"), (F.col("current_version") + 1).alias("version"), "conflict")


@query(f"SELECT key, version, updated_at_unix FROM {_LATEST} WHERE NOT removed")
def state_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.describe(_user_versions(spark, sf_dir)).select("key", "version", "updated_at_unix")


@query(f"SELECT key, version FROM {_LATEST} WHERE removed")
def state_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _user_versions(spark, sf_dir).withColumnRenamed("removed", "gone")
    return state.latest(rows).where("gone").select("key", "version")


@query(f"SELECT key, {_K} AS k FROM {_DOCS}")
def state_typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.load(_docs(spark, sf_dir).select("key", "doc"), T.StructType([T.StructField("k", T.LongType())]))


@query("SELECT printf('orders/%d', o_orderkey) AS key, concat('{\"status\":\"', o_orderstatus, '\",\"priority\":\"', o_orderpriority, '\"}') AS doc FROM orders")
def state_typed_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.format_string("orders/%d", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return state.save(o, ["status", "priority"])


@query(f"SELECT key, version, version % 2 = 0 AS query_hidden FROM {_LATEST} WHERE NOT removed")
def state_set_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _user_heads(spark, sf_dir)
    marks = state.latest(versions).select("namespace", "key", (F.col("version") % 2 == 0).alias("query_hidden"))
    return state.set_hidden(versions, marks).select("key", "version", "query_hidden")


@query(f"SELECT key, max(version) AS version FROM {_VERSIONS} WHERE event_id % 4 <> 0 GROUP BY key")
def state_public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _user_versions(spark, sf_dir).drop("removed").withColumn("committed", F.col("event_id") % 4 != 0)
    return state.latest(staged, public=True).select("key", "version")


@query(
    f"""SELECT key, version + 1 AS version, concat('{{"k":', TRY_CAST(json_extract(doc, '/k') AS BIGINT) + 1, ',"seen":true}}') AS doc FROM {_LATEST} WHERE NOT removed AND version % 2 = 0
    UNION ALL SELECT printf('new/%d', r_regionkey), 1, '{{"k":1,"seen":true}}' FROM region"""
)
def state_mutate_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _user_versions(spark, sf_dir)
    old = state.latest(versions).where("version % 2 = 0").select("namespace", "key")
    new = _table(spark, sf_dir, "region").select(F.lit("default").alias("namespace"), F.format_string("new/%d", "r_regionkey").alias("key"))
    return state.mutate_local(versions, old.union(new), Parser().plan(["/k++", "/seen=true"])).select("key", "version", "doc")


# --- leases


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lease for each event on its user's key, for an hour to a week."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.lit("default").alias("namespace"), F.format_string("user/%d", "user_id").alias("key"), F.col("event_id").cast("string").alias("lease_id"), F.format_string("owner-%d", F.col("event_id") % 9).alias("owner"), F.col("event_id").alias("fencing_token"), (_seconds() + 3600 * (F.col("event_id") % 168)).cast("long").alias("expires_at_unix"))


_LEASES = "(SELECT printf('user/%d', user_id) AS key, CAST(event_id AS VARCHAR) AS lease_id, event_id AS fencing_token, CAST(floor(epoch(ts)) AS BIGINT) + 3600 * (event_id % 168) AS expires_at_unix FROM events)"
_CURRENT = f"(SELECT * FROM {_LEASES} QUALIFY row_number() OVER (PARTITION BY key ORDER BY fencing_token DESC) = 1)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.lit("default").alias("namespace"), F.format_string("user/%d", F.col("c_custkey") % 500).alias("key"), F.col("c_name").alias("owner"), F.lit(60).alias("ttl_seconds"), F.col("c_custkey").alias("request_id"))


_REQUESTS = "(SELECT printf('user/%d', c_custkey % 500) AS key, c_name AS owner, c_custkey AS request_id FROM customer)"


@query(f"SELECT key, lease_id FROM {_LEASES} WHERE expires_at_unix <= {NOW}")
def lease_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.expired(_leases(spark, sf_dir), NOW).select("key", "lease_id")


@query(f"SELECT key, lease_id, fencing_token % 2 = 0 OR expires_at_unix <= {NOW} AS free FROM {_CURRENT}")
def lease_release_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current leases after those with even tokens were released: which keys are free."""
    rows = leases.current(_leases(spark, sf_dir))
    after = leases.release_leases(rows, rows.where("fencing_token % 2 = 0").select("namespace", "key", "lease_id"), NOW)
    return after.select("key", "lease_id", (F.col("expires_at_unix") <= NOW).alias("free"))


@query(f"SELECT key, lease_id, fencing_token FROM {_CURRENT}")
def lease_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.current(_leases(spark, sf_dir)).select("key", "lease_id", "fencing_token")


@query(
    f"""SELECT r.key, arg_min(r.owner, r.request_id) AS owner, coalesce(max(l.fencing_token), 0) + 1 AS fencing_token, {NOW} + 60 AS expires_at_unix
    FROM {_REQUESTS} r LEFT JOIN (SELECT key, max(fencing_token) AS fencing_token, max(expires_at_unix) AS until FROM {_LEASES} GROUP BY key) l USING (key)
    WHERE coalesce(l.until, 0) <= {NOW} GROUP BY r.key"""
)
def lease_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.acquire(_leases(spark, sf_dir), _requests(spark, sf_dir), NOW).select("key", "owner", "fencing_token", F.col("expires_at_unix").cast("int").alias("expires_at_unix"))


@query(f"SELECT r.key, arg_min(r.owner, r.request_id) AS owner FROM {_REQUESTS} r WHERE r.key NOT IN (SELECT key FROM {_LEASES}) GROUP BY r.key")
def lease_if_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _leases(spark, sf_dir)
    return leases.acquire(held, _requests(spark, sf_dir), NOW, if_not_exists=True, existing=held.select("namespace", "key").distinct()).select("key", "owner")


@query(f"SELECT key, lease_id, {NOW} + 900 AS expires_at_unix FROM {_CURRENT} WHERE expires_at_unix > {NOW}")
def lease_keepalive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leases(spark, sf_dir)
    beats = rows.select("namespace", "key", "lease_id", F.lit(900).alias("ttl_seconds"))
    return leases.keepalive(rows, beats, NOW).select("key", "lease_id", F.col("expires_at_unix").cast("int").alias("expires_at_unix"))


@query(f"SELECT key, version, committed FROM (SELECT *, event_id % 4 <> 0 OR event_id % 8 = 4 AS committed FROM {_VERSIONS}) WHERE NOT (event_id % 16 = 0)")
def lease_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _user_versions(spark, sf_dir).withColumn("committed", F.col("event_id") % 4 != 0).withColumn("txn_id", F.col("event_id"))
    done = staged.where("not committed and (event_id % 8 = 4 or event_id % 16 = 0)").select("namespace", "key", "txn_id", (F.col("event_id") % 16 == 0).alias("rollback"))
    return leases.release(staged, done).select("key", "version", "committed")


@query(f"SELECT key, fencing_token FROM {_CURRENT} WHERE fencing_token % 2 = 0 AND expires_at_unix > {NOW}")
def lease_fenced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leases(spark, sf_dir)
    # writes with odd tokens come with the token before theirs, which is stale
    writes = rows.withColumn("fencing_token", F.col("fencing_token") - F.col("fencing_token") % 2)
    return leases.fenced_writes(writes, rows, NOW).select("key", "fencing_token")


@query(
    f"""SELECT key, coalesce(l.version, 0) + 1 AS version, '{{"seen":' || CASE WHEN l.removed THEN 0 ELSE coalesce(l.version, 0) END || '}}' AS doc FROM (SELECT DISTINCT key FROM {_REQUESTS}) r
    LEFT JOIN (SELECT key, max(expires_at_unix) AS until FROM {_LEASES} GROUP BY key) h USING (key) LEFT JOIN {_LATEST} l USING (key) WHERE coalesce(h.until, 0) <= {NOW}"""
)
def lease_acquire_for_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    def handler(seen: DataFrame) -> DataFrame:
        return seen.select("namespace", "key", F.to_json(F.struct(F.coalesce("version", F.lit(0)).alias("seen"))).alias("doc"))

    made = leases.acquire_for_update(_leases(spark, sf_dir), partial(_user_versions, spark, sf_dir), _requests(spark, sf_dir), NOW, handler)
    return made.staged.select("key", "version", "doc")


# --- queues


@query(f"SELECT queue, message_id, not_visible_until_unix, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes FROM {_MESSAGES}")
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("queue", "message_id", "not_visible_until_unix", "payload_bytes")


@query(f"SELECT message_id, 'defer' AS kind, CAST(45 AS BIGINT) AS delay_seconds FROM {_MESSAGES} WHERE message_id % 5 = 0")
def queue_nack_defer(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _message_events(spark, sf_dir).where("kind = 'ack'")
    return queues.nack(given, "defer", 45).select("message_id", "kind", "delay_seconds")


@query(f"SELECT queue, message_id FROM {_MESSAGES} WHERE {_READY}")
def queue_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0)).where(queues.deliverable(F.lit(NOW))).select("queue", "message_id")


@query(f"SELECT queue, message_id, CAST(row_number() OVER (PARTITION BY queue ORDER BY enqueued_at_unix, message_id) AS INTEGER) AS rank FROM {_MESSAGES} WHERE {_READY} QUALIFY rank <= 5")
def queue_dequeue_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0))
    return queues.dequeue(rows, F.lit(NOW), page_size=5).select("queue", "message_id", "rank")


@query(f"SELECT queue, message_id FROM {_MESSAGES} WHERE {_READY} AND message_id > 500 QUALIFY row_number() OVER (PARTITION BY queue ORDER BY enqueued_at_unix, message_id) = 1")
def queue_start_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0))
    return queues.dequeue(rows, F.lit(NOW), start_after=F.lit(500)).select("queue", "message_id")


@query(f"SELECT queue, message_id FROM {_MESSAGES} WHERE message_id % 5 <> 0")
def queue_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = _message_events(spark, sf_dir).where("kind = 'ack'")
    return queues.ack(_messages(spark, sf_dir), acks).select("queue", "message_id")


_FAILURES = "(CASE WHEN message_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN message_id % 6 = 1 THEN 1 ELSE 0 END + CASE WHEN message_id % 12 = 1 THEN 1 ELSE 0 END)"


@query(
    f"""SELECT queue, message_id, CAST({_FAILURES} AS BIGINT) AS failure_attempts, enqueued_at_unix + CASE WHEN message_id % 8 = 6 THEN 7 + 90 WHEN message_id % 4 = 2 THEN 6 + 600
    WHEN message_id % 12 = 1 THEN 5 + 240 WHEN message_id % 6 = 1 THEN 4 + 120 WHEN message_id % 3 = 1 THEN 3 + 60 ELSE 1 + 30 END AS not_visible_until_unix FROM {_MESSAGES} WHERE message_id % 5 <> 0"""
)
def queue_nack_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.fold(_messages(spark, sf_dir), _message_events(spark, sf_dir)).select("queue", "message_id", "failure_attempts", "not_visible_until_unix")


@query(f"SELECT queue, count(*) AS exhausted FROM {_MESSAGES} WHERE message_id % 5 <> 0 AND {_FAILURES} >= 3 GROUP BY queue")
def queue_failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = queues.fold(_messages(spark, sf_dir), _message_events(spark, sf_dir))
    return folded.where("failure_attempts >= max_attempts").groupBy("queue").agg(F.count(F.lit(1)).alias("exhausted"))


@query(
    f"""SELECT queue, count(*) FILTER ({_READY}) AS pending_candidates, count(*) FILTER ({_READY}) > 0 AS available, arg_min(message_id, enqueued_at_unix * 1000000000 + message_id) FILTER ({_READY}) AS head_message_id,
    min(enqueued_at_unix) FILTER ({_READY}) AS head_enqueued_at_unix, {NOW} - min(enqueued_at_unix) FILTER ({_READY}) AS head_age_seconds, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS waiting_consumers,
    count(DISTINCT user_id) AS total_consumers FROM {_MESSAGES} GROUP BY queue"""
)
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0))
    here = rows.select("namespace", "queue", F.col("user_id").alias("consumer"), (F.col("user_id") % 2 == 0).alias("waiting")).distinct()
    return queues.stats(rows, F.lit(NOW), here).select("queue", "pending_candidates", "available", "head_message_id", "head_enqueued_at_unix", "head_age_seconds", "waiting_consumers", "total_consumers")


def _consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to four consumers for each queue, which ask for 3 messages each."""
    r = _table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("request_id"), F.col("n_name").alias("consumer"))
    q = F.explode(F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))).alias("queue")
    return r.select(F.lit("default").alias("namespace"), q, "consumer", F.lit(3).alias("page_size"), "request_id")


_DELIVERED = f"""(SELECT queue, message_id, n_name AS consumer, {NOW} + 30 AS until FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY enqueued_at_unix, message_id) AS rank FROM {_MESSAGES} WHERE {_READY})
    JOIN nation ON n_nationkey = (rank - 1) // 3 WHERE rank <= 12)"""


@query(f"SELECT queue, message_id, consumer, until AS lease_expires_at_unix FROM {_DELIVERED}")
def queue_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0)).withColumn("attempts", F.lit(0))
    return queues.deliver(rows, _consumers(spark, sf_dir), NOW).select("queue", "message_id", "consumer", F.col("lease_expires_at_unix").cast("int").alias("lease_expires_at_unix"))


@query(f"SELECT queue, message_id, {NOW} + 10 + message_id % 100 AS lease_expires_at_unix FROM {_DELIVERED} WHERE until > {NOW} + 10")
def queue_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure_attempts", F.lit(0)).withColumn("attempts", F.lit(0))
    made = queues.deliver(rows, _consumers(spark, sf_dir), NOW)
    asks = made.select("message_id", "lease_id", (F.col("message_id") % 100).alias("extend_seconds"))
    return queues.extend(made, asks, NOW + 10).select("queue", "message_id", "lease_expires_at_unix")


@query(f"SELECT queue, message_id FROM {_MESSAGES} WHERE {_READY} AND (queue, message_id) NOT IN (SELECT (queue, message_id) FROM {_DELIVERED})")
def queue_delivered_are_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second batch of consumers may still get, right after the first."""
    messages = _messages(spark, sf_dir)
    rows = messages.withColumn("failure_attempts", F.lit(0)).withColumn("attempts", F.lit(0))
    made = queues.deliver(rows, _consumers(spark, sf_dir), NOW).select("message_id", "kind", "at_unix", "delay_seconds")
    return queues.fold(messages, made).where(queues.deliverable(F.lit(NOW))).select("queue", "message_id")


@query(f"SELECT queue, message_id, printf('q/%s/state/%d', queue, message_id) AS state_key, CASE WHEN message_id % 2 = 0 THEN c_name END AS c_name FROM {_MESSAGES} LEFT JOIN customer ON user_id = c_custkey")
def queue_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    bound = messages.where("message_id % 2 = 0").join(c, "user_id").select("namespace", scalars.queue_state_key(F.col("queue"), F.col("message_id").cast("string")).alias("key"), "c_name")
    return queues.with_state(messages, bound).select("queue", "message_id", "state_key", "c_name")


@query(
    f"""WITH o AS (SELECT event_type AS queue, event_id AS seq, value >= 50 AS available, CAST(user_id % 3 AS VARCHAR) AS head_message_id FROM events),
    s AS (SELECT *, lag(struct_pack(a := available, h := head_message_id)) OVER (PARTITION BY queue ORDER BY seq) AS before FROM o)
    SELECT queue, seq, available, head_message_id FROM s WHERE before IS DISTINCT FROM struct_pack(a := available, h := head_message_id)"""
)
def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    seen = e.select(F.lit("default").alias("namespace"), F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), (F.col("value") >= 50).alias("available"), (F.col("user_id") % 3).cast("string").alias("head_message_id"))
    return watch.changes(seen).select("queue", "seq", "available", "head_message_id")


# --- attachments


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.lit("default").alias("namespace"), F.format_string("site/%d", F.col("page_id") % 10).alias("key"), F.col("page_id").alias("id"), F.col("url").alias("name"), F.col("html").alias("payload"))


@query("SELECT page_id AS id, url AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS plaintext_sha256 FROM pages")
def attachment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.described(_attachments(spark, sf_dir)).select("id", "name", "size", "plaintext_sha256")


_FILES = "(SELECT page_id AS id, printf('site/%d', page_id % 10) AS key, printf('file-%d', page_id % 70) AS name, html FROM pages)"


@query(
    f"""SELECT id, CASE WHEN octet_length(encode(html)) > 4000 THEN 'too_large' WHEN row_number() OVER (PARTITION BY key, name ORDER BY id) > 1 OR bool_or(id % 7 = 0) OVER (PARTITION BY key, name) THEN 'exists' ELSE 'stored' END AS outcome
    FROM {_FILES}""",
)
def attachment_prevent_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _attachments(spark, sf_dir).withColumn("name", F.format_string("file-%d", F.col("id") % 70))
    stored = attachments.described(files.where("id % 7 = 0")).groupBy("namespace", "key", "name").agg(F.min_by("plaintext_sha256", "id").alias("plaintext_sha256"))
    return attachments.attach(stored, files, F.col("id"), max_bytes=4000, prevent_overwrite=True).select("id", "outcome")


@query("SELECT page_id AS id, url AS name FROM pages WHERE url NOT IN (SELECT url FROM pages p WHERE p.page_id % 3 = 0 AND p.page_id % 10 = pages.page_id % 10)")
def attachment_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _attachments(spark, sf_dir)
    return attachments.delete(stored, stored.where("id % 3 = 0").select("namespace", "key", "name").distinct())[0].select("id", "name")


@query("SELECT count(*) AS deleted_count FROM pages WHERE page_id % 10 = 3")
def attachment_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.delete(attachments.listing(_attachments(spark, sf_dir), "default", "site/3"))[1]


@query("SELECT page_id AS id, html AS payload FROM pages WHERE url = (SELECT min(url) FROM pages)")
def attachment_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _attachments(spark, sf_dir)
    return attachments.select(stored, name=stored.agg(F.min("name")).first()[0]).select("id", "payload")


@query("SELECT page_id AS id, url AS name FROM pages WHERE page_id = 7")
def attachment_get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.select(_attachments(spark, sf_dir), attachment_id=7).select("id", "name")


# --- sources and sinks


@query("SELECT * FROM (VALUES ('a', 1), ('', 0), ('äb', 3)) t(text, size)")
def source_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bytes_io.from_memory(spark, [b"a", b"", "äb".encode()])
    return rows.select(F.col("content").cast("string").alias("text"), F.octet_length("content").alias("size"))


_CONTENT = "(SELECT coalesce(text, '') AS content FROM documents)"


def _written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The texts of documents, written by the file sink; its path."""
    path = shared_path(spark, f"sink-{kind}")
    bytes_io.to_files(_table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("content")), path, kind)
    return path


@query(f"SELECT count(*) AS n, CAST(sum(octet_length(encode(content))) AS BIGINT) AS size, sha256(string_agg(sha256(content), '' ORDER BY sha256(content))) AS digest FROM {_CONTENT}")
def sink_files_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as JSON lines and read back with their schema."""
    back = bytes_io.ndjson(spark, _written(spark, sf_dir, "json"), "content string")
    told = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("size"), F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), "").alias("all"))
    return told.select("n", "size", F.sha2("all", 256).alias("digest"))


@query("SELECT r_name AS name, r_name || chr(10) AS text FROM region")
def source_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as one text file each, read whole: as bytes with their path, and as text."""
    path = shared_path(spark, "region-files")
    r = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("value"))
    r.write.partitionBy("name").text(path)
    files = bytes_io.from_files(spark, f"{path}/*", "*.txt").select(F.url_decode(F.regexp_extract("path", "name=([^/]*)/", 1)).alias("name"), F.col("content").cast("string").alias("text"))
    return files.join(bytes_io.from_text_files(spark, f"{path}/*").select(F.col("value").alias("text")), "text", "left_semi")


@query("SELECT CAST(p AS INTEGER) AS part, CAST(s AS BIGINT) AS seq, printf('%d-%d', p, s) AS text FROM range(3) a(p), range(4) b(s)")
def source_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytes_io.from_callback(spark, "larkspur.queries:numbered_items", 3).select("part", "seq", F.col("content").cast("string").alias("text"))


def numbered_items(part: int) -> Iterator[bytes]:
    """What the callback source of :func:`source_callback` yields for a partition."""
    return (f"{part}-{i}".encode() for i in range(4))


@query(f"SELECT CAST(sum(octet_length(encode(content))) AS BIGINT) AS written FROM {_CONTENT}")
def io_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("content"))
    return bytes_io.copy(texts, shared_path(spark, "copy"))


@query("SELECT n_name AS name FROM nation")
def sink_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = bytes_io.to_memory(_table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("content")), limit_bytes=1000)
    return spark.createDataFrame([(c.decode(),) for c in contents], "name string")


@query("SELECT 5 AS parts, sum(length(r_name)) AS size FROM region")
def sink_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region handed to a callback in the tasks, which counts its bytes."""
    context = spark.sparkContext
    parts, size = context.accumulator(0), context.accumulator(0)

    def write(data: bytes) -> None:
        parts.add(1)
        size.add(len(data))

    bytes_io.to_callback(_table(spark, sf_dir, "region").select(F.col("r_name").cast("binary").alias("content")), write)
    return spark.createDataFrame([(parts.value, size.value)], "parts int, size long")


# --- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a stream of Parquet files."""
    path = shared_path(spark, "messages")
    _messages(spark, sf_dir).select("namespace", "queue", "message_id", "user_id").repartition(3).write.parquet(path)
    return subscribe.message_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def _subscribed(spark: SparkSession, stream: DataFrame, states: DataFrame | None, handler: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out, checkpoint = shared_path(spark, "actions"), shared_path(spark, "checkpoint")

    def write(actions: DataFrame, number: int) -> None:
        actions.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = subscribe.subscribe(stream, handler, write, checkpoint) if states is None else subscribe.subscribe_with_state(stream, states, handler, write, checkpoint)
    run.awaitTermination()
    return spark.read.parquet(out).select("message_id", "action")


@query(f"SELECT message_id, CASE WHEN message_id % 11 = 0 THEN 'nack_defer' WHEN message_id % 7 = 0 OR message_id % 5 = 0 THEN 'nack_failure' ELSE 'ack' END AS action FROM {_MESSAGES}")
def stream_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that fails some messages, leaves some out, and defers some by an action of its own."""
    own = F.when(F.col("message_id") % 11 == 0, "nack_defer").alias("action")
    return _subscribed(spark, _stream(spark, sf_dir), None, lambda b: b.where("message_id % 5 <> 0 or message_id % 11 = 0").select("message_id", (F.col("message_id") % 7 != 0).alias("ok"), own))


@query(f"SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'ack' ELSE 'nack_failure' END AS action FROM {_MESSAGES}")
def stream_subscribe_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that takes the messages with a state bound to them."""
    states = _messages(spark, sf_dir).where("message_id % 2 = 0").select("namespace", scalars.queue_state_key(F.col("queue"), F.col("message_id").cast("string")).alias("key"), F.lit("{}").alias("doc"))
    return _subscribed(spark, _stream(spark, sf_dir), states, lambda b: b.select("message_id", F.col("doc").isNotNull().alias("ok")))


@query("SELECT 'default' AS namespace, event_type AS queue, event_id % 2 = 0 AS available, CAST(event_id AS VARCHAR) AS head_message_id FROM events WHERE event_id % 3 <> 1")
def stream_sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events, of which every third has another name."""
    e = _table(spark, sf_dir, "events")
    data = F.to_json(F.struct(F.lit("default").alias("namespace"), F.col("event_type").alias("queue"), (F.col("event_id") % 2 == 0).alias("available"), F.col("event_id").cast("string").alias("head_message_id")))
    lines = e.select(F.when(F.col("event_id") % 3 == 0, "queue_watch").when(F.col("event_id") % 3 == 1, "ping").alias("event"), data.alias("data"))
    return watch.sse_events(lines).select("namespace", "queue", "available", "head_message_id")


# --- scalar functions


@query("SELECT * FROM (VALUES ('/a~1b/~0c', 'a/b|~c', CAST(NULL AS VARCHAR)), ('/~01', '~1', NULL), ('/a/0', 'a|0', NULL), ('a', NULL, 'a path must start with ' || chr(39) || '/' || chr(39)), ('/', NULL, 'mutation path refers to document root'), ('/*', NULL, 'wildcards are not supported in paths: *')) t(pointer, segments, error)")
def scalar_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(pointer: str) -> tuple[str, str | None, str | None]:
        try:
            return pointer, "|".join(pointers.parse(pointer)), None
        except pointers.PointerError as e:
            return pointer, None, str(e)

    return spark.createDataFrame([parsed(p) for p in ("/a~1b/~0c", "/~01", "/a/0", "a", "/", "/*")], "pointer string, segments string, error string")


@query("SELECT doc_id, text IS NOT NULL AS clean, text FROM documents")
def scalar_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes: all are clean, and come back as they are."""
    data = F.col("text").cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(scalars.is_clean_text(data), F.lit(False)).alias("clean"), scalars.text_or_base64(data).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '9223372036854775807' WHEN 1 THEN '-9223372036854775808' END AS i64, CASE event_id % 4 WHEN 0 THEN '9223372036854775807' WHEN 2 THEN '18446744073709551615' END AS u64 FROM events")
def scalar_number_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(x) for x in ("9223372036854775807", "-9223372036854775808", "18446744073709551615", "18446744073709551616")))
    text = F.get(texts, (F.col("event_id") % 4).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", scalars.int64(text).cast("string").alias("i64"), scalars.uint64(text).cast("string").alias("u64"))


@query("SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def scalar_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.base64(F.col("text").cast("binary")).alias("b64"))


@query("SELECT page_id, url_encode(url) AS coded, rtrim(url, '/') AS endpoint FROM pages")
def scalar_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", scalars.url_encoded(F.col("url")).alias("coded"), scalars.endpoint(F.col("url")).alias("endpoint"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS token, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), 'default') AS namespace FROM part")
def scalar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.safe_token(F.col("p_name")).alias("token"), scalars.effective_namespace(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))).alias("namespace"))


@query("SELECT event_id, strftime(ts - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.5Z' AS utc FROM events")
def scalar_time_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".500000000+02:30"))
    return _table(spark, sf_dir, "events").select("event_id", times.utc_column(text).alias("utc"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS i64, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS DECIMAL(20,0)) AS u64 FROM events")
def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", scalars.int64(text).alias("i64"), scalars.uint64(text).alias("u64"))


# --- consumers and catalog


@query(
    """WITH RECURSIVE d(policy, k, delay, base, factor, cap) AS (SELECT p, 0, base, base, factor, cap FROM (VALUES (1, 250, 1.02::DOUBLE, 300000), (2, 250, 1.0::DOUBLE, 300000), (3, 100, 1.5::DOUBLE, 2000), (4, 5000, 2.0::DOUBLE, 1000)) t(p, base, factor, cap)
    UNION ALL SELECT policy, k + 1, CASE WHEN delay * factor <= delay OR delay * factor >= cap THEN cap ELSE CAST(floor(delay * factor) AS INTEGER) END, base, factor, cap FROM d WHERE k < 498)
    SELECT policy, CAST(k + 2 AS BIGINT) AS failures, CAST(least(delay, cap) AS BIGINT) AS delay_ms FROM d UNION ALL SELECT p, 1, 0 FROM range(1, 5) t(p)"""
)
def consumer_backoff_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow growth, none, a low cap, and a base above the cap, for 500 failures; the first is retried at once."""
    policies = [(1, 250, 1.02, 300_000), (2, 250, 1.0, 300_000), (3, 100, 1.5, 2_000), (4, 5_000, 2.0, 1_000)]
    n = spark.range(1, 501)
    return reduce(DataFrame.union, [n.select(F.lit(p).alias("policy"), F.col("id").alias("failures"), backoff.restart_delay_ms(F.col("id"), 1, base, factor, cap).alias("delay_ms")) for p, base, factor, cap in policies])


@query("SELECT CAST(n AS BIGINT) AS failures, CASE WHEN n <= 3 THEN 0 ELSE CAST(least(250 * pow(2, n - 4), 300000) AS BIGINT) END AS delay_ms FROM range(1, 40) t(n)")
def consumer_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 40).select(F.col("id").alias("failures"), backoff.restart_delay_ms(F.col("id")).alias("delay_ms"))


@query("SELECT CAST(n AS BIGINT) AS status, n BETWEEN 400 AND 499 AND n NOT IN (408, 429) AS fatal, greatest(250, least(30000, (n - 399) * 500)) AS extend_ms FROM range(399, 520) t(n)")
def consumer_retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return spark.range(399, 520).select(n.alias("status"), backoff.is_fatal(F.lit(None).cast("string"), n).alias("fatal"), backoff.extend_after_ms(n - 399).alias("extend_ms"))


_OUTCOMES = "(SELECT user_id AS consumer, event_id AS seq, CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'delivery_error' ELSE 'failure' END AS outcome FROM events)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "delivery_error").otherwise("failure")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("consumer"), F.col("event_id").alias("seq"), kind.alias("outcome"))


_RUNS = f"""(SELECT consumer, seq, outcome, CASE WHEN outcome = 'delivery_error' THEN 0 ELSE CAST(count(*) FILTER (outcome = 'failure') OVER (PARTITION BY consumer, run ORDER BY seq) AS BIGINT) END AS failures
    FROM (SELECT *, count(*) FILTER (outcome = 'success') OVER (PARTITION BY consumer ORDER BY seq) AS run FROM {_OUTCOMES}))"""


@query(f"SELECT consumer, seq, failures FROM {_RUNS}")
def consumer_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumers.failure_runs(_outcomes(spark, sf_dir)).select("consumer", "seq", "failures")


@query(f"SELECT consumer, min(seq) FILTER (failures > 4) AS stopped_at FROM {_RUNS} GROUP BY consumer")
def consumer_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumers.stops(consumers.failure_runs(_outcomes(spark, sf_dir)), 4)


_TERMINAL = "CASE WHEN bool_or(event_type = 'purchase') THEN 'terminal' WHEN bool_or(event_type = 'error') THEN 'indeterminate' WHEN bool_or(event_type = 'click') THEN 'terminal_in_progress' WHEN bool_or(event_type = 'view') THEN 'extender_stopped' ELSE 'open' END"


@query(f"SELECT event_id // 3 AS delivery_id, {_TERMINAL} AS state FROM events GROUP BY 1")
def consumer_delivery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    names = F.when(kind == "purchase", "ack_ok").when(kind == "error", "nack_lost").when(kind == "click", "ack").when(kind == "view", "extender_stopped").otherwise("begin")
    e = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("delivery_id"), names.alias("kind"))
    return consumers.delivery_state(e)


@query("SELECT s_nationkey AS backend_hash, string_agg(s_name, ',' ORDER BY s_name) AS endpoints FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY s_nationkey")
def rm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("backend_hash"), F.col("s_name").alias("endpoint"), "s_suppkey")
    events = s.select("backend_hash", "endpoint", F.lit("register").alias("kind"), F.lit(1).alias("seq"))
    events = events.union(s.where("s_suppkey % 4 = 0").select("backend_hash", "endpoint", F.lit("unregister").alias("kind"), F.lit(2).alias("seq")))
    return catalog.registry(events).select("backend_hash", F.array_join("endpoints", ",").alias("endpoints"))


@query("SELECT string_agg(s_name, ',' ORDER BY s_name) AS endpoints FROM supplier WHERE s_suppkey % 3 <> 0")
def tc_cluster_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    events = s.select(F.col("s_name").alias("endpoint"), F.lit("announce").alias("kind"), F.lit(1).alias("seq"))
    events = events.union(s.where("s_suppkey % 3 = 0").select(F.col("s_name"), F.lit("leave"), F.lit(2)))
    return catalog.cluster(events).select(F.array_join("endpoints", ",").alias("endpoints"))


@query("SELECT printf('node-%d', user_id) AS leader_id, event_id AS term, CAST(floor(epoch(ts)) AS BIGINT) + 60 AS expires_at FROM events WHERE event_id % 2 = 1 AND event_id = (SELECT max(event_id) FROM events)")
def tc_leader_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that were renewed for a minute; those with even numbers were then released."""
    e = _table(spark, sf_dir, "events")
    terms = e.select(F.format_string("node-%d", "user_id").alias("leader_id"), F.col("event_id").alias("term"), _seconds().alias("expires_at"), F.lit("acquire").alias("event"), F.lit(1).alias("seq"))
    renewed = terms.withColumn("expires_at", F.col("expires_at") + 60).withColumn("event", F.lit("renew")).withColumn("seq", F.lit(2))
    released = terms.where("term % 2 = 0").withColumn("event", F.lit("release")).withColumn("seq", F.lit(3))
    return catalog.leader(terms.union(renewed).union(released))


@query("SELECT printf('node-%d', arg_max(user_id, event_id)) AS leader_id, max(event_id) AS term FROM events")
def tc_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    terms = e.select(F.format_string("node-%d", "user_id").alias("leader_id"), F.col("event_id").alias("term"), _seconds().alias("expires_at"), F.lit("acquire").alias("event"), F.lit(1).alias("seq"))
    return catalog.leader(terms).select("leader_id", "term")


@query(f"SELECT event_id, user_id % 4 = event_id % 4 OR event_id % 10 = 0 OR CAST(floor(epoch(ts)) AS BIGINT) <= {NOW} OR user_id > event_id AS granted FROM events")
def tc_lease_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    asked = e.select("event_id", (F.col("user_id") % 4).alias("candidate"), F.col("user_id").alias("term"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 4).alias("held_by"), F.col("event_id").alias("held_term"), _seconds().alias("held_until"))
    return catalog.leader_decisions(asked, NOW).select("event_id", F.col("granted").alias("granted"))


@query("SELECT o_orderkey AS txn_id, 'commit' AS state, l_suppkey AS backend_hash FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey")
def txn_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn_id")).agg(F.collect_set(F.struct(F.col("l_suppkey").alias("backend_hash"))).alias("participants"))
    return catalog.participants(grouped.withColumn("state", F.lit("commit")))


@query(
    """SELECT user_id AS txn_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'commit' ELSE 'rollback' END, event_id) FILTER (event_type IN ('purchase', 'error')), 'prepare') AS state
    FROM events WHERE event_type IN ('purchase', 'error', 'view') GROUP BY user_id"""
)
def txn_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("txn_id"), F.when(kind == "purchase", "commit").when(kind == "error", "rollback").when(kind == "view", "prepare").alias("state"), F.col("event_id").alias("seq"))
    return catalog.transactions(e)


@query("SELECT 'FRANCE' AS namespace, 'scan' AS preferred_engine, n_regionkey AS region FROM nation WHERE n_name = 'FRANCE'")
def namespace_config_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("namespace"), F.lit("scan").alias("preferred_engine"), F.col("n_regionkey").alias("region"))
    return catalog.namespace_config(configs, "FRANCE")


@query("SELECT n_name AS namespace, CASE WHEN n_nationkey % 2 = 0 THEN 'index' ELSE 'scan' END AS preferred_engine, 'scan' AS fallback_engine FROM nation")
def namespace_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    configs = n.select(F.col("n_name").alias("namespace"), F.lit("scan").alias("preferred_engine"), F.lit("scan").alias("fallback_engine"))
    changes = n.select(F.col("n_name").alias("namespace"), F.when(F.col("n_nationkey") % 2 == 0, "index").alias("preferred_engine"), F.lit(None).cast("string").alias("fallback_engine"))
    return catalog.update_namespace_config(configs, changes)


@query("SELECT 'view' AS namespace, 'wait' AS mode, true AS accepted, true AS flushed, false AS pending, count(*) + 1 AS index_seq FROM events WHERE event_type = 'view'")
def index_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_type = 'view'")
    flushes = e.groupBy(F.col("event_type").alias("namespace")).agg(F.count(F.lit(1)).alias("index_seq"))
    return catalog.flush_index(flushes, "view")
