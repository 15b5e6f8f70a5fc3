"""Catalog and coordination tables: namespace settings, index flushes, transactions, leader, cluster, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of a transaction decision.
DECISIONS = ("prepare", "commit", "rollback")


def namespace_config(configs: DataFrame, namespace: str) -> DataFrame:
    """Settings of one namespace, by its name as given."""
    return configs.where(F.col("namespace") == namespace)


def update_namespace_config(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings after ``changes(namespace, preferred_engine, fallback_engine)``; null leaves a value, and null twice the row."""
    new = changes.select("namespace", F.col("preferred_engine").alias("_p"), F.col("fallback_engine").alias("_f")).where("_p is not null or _f is not null")
    return configs.join(new, "namespace", "full_outer").select("namespace", F.coalesce("_p", "preferred_engine").alias("preferred_engine"), F.coalesce("_f", "fallback_engine").alias("fallback_engine"))


def flush_index(flushes: DataFrame, namespace: str, mode: str = "wait") -> DataFrame:
    """The record of a new flush of a namespace: its sequence is one above the last."""
    last = flushes.where(F.col("namespace") == namespace).agg(F.coalesce(F.max("index_seq"), F.lit(0)).alias("n"))
    waits = F.lit(mode == "wait")
    return last.select(F.lit(namespace).alias("namespace"), F.lit(mode).alias("mode"), F.lit(True).alias("accepted"), waits.alias("flushed"), (~waits).alias("pending"), (F.col("n") + 1).alias("index_seq"))


def transactions(decisions: DataFrame) -> DataFrame:
    """State of every transaction after ``decisions(txn_id, state, seq)``: a commit or rollback, once made, stays."""
    final = F.min(F.when(F.col("state").isin("commit", "rollback"), F.struct("seq", "state")))
    return decisions.where(F.col("state").isin(*DECISIONS)).groupBy("txn_id").agg(F.coalesce(final["state"], F.max("state")).alias("state"))


def participants(transactions_of: DataFrame) -> DataFrame:
    """One row for each participant of a transaction."""
    return transactions_of.select("txn_id", "state", F.explode("participants").alias("p")).select("txn_id", "state", "p.*")


def leader(terms: DataFrame) -> DataFrame:
    """The leader of the highest term whose lease has not been released."""
    last = terms.agg(F.max_by(F.struct("leader_id", "term", "expires_at", "event"), F.struct("term", "seq")).alias("l")).select("l.*")
    return last.where("event <> 'release'").drop("event")


def leader_decisions(requests: DataFrame, now: int) -> DataFrame:
    """Whether each ``requests(candidate, term, held_by, held_term, held_until)`` is granted: free, expired, own, or of a higher term."""
    free = F.col("held_by").isNull() | (F.col("held_until") <= now) | (F.col("held_by") == F.col("candidate"))
    return requests.withColumn("granted", free | (F.col("term") > F.col("held_term")))


def cluster(events: DataFrame) -> DataFrame:
    """Endpoints whose last event ``(endpoint, kind, seq)`` is an announcement, in one sorted array."""
    last = events.groupBy("endpoint").agg(F.max_by("kind", "seq").alias("kind"))
    return last.where("kind = 'announce'").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))


def registry(events: DataFrame) -> DataFrame:
    """For each backend the sorted endpoints whose last event ``(backend_hash, endpoint, kind, seq)`` is a registration."""
    last = events.groupBy("backend_hash", "endpoint").agg(F.max_by("kind", "seq").alias("kind"))
    return last.where("kind = 'register'").groupBy("backend_hash").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))
