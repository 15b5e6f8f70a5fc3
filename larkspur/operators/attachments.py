"""Attachments: named binary objects of a key, with size and SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OWNER = ("namespace", "key")


def described(files: DataFrame, payload: str = "payload") -> DataFrame:
    """``files`` with ``size`` and ``plaintext_sha256``, without the payload."""
    return files.withColumn("size", F.octet_length(payload).cast("long")).withColumn("plaintext_sha256", F.sha2(F.col(payload).cast("binary"), 256)).drop(payload)


def attach(stored: DataFrame, files: DataFrame, order: Column, max_bytes: int = 0, prevent_overwrite: bool = False) -> DataFrame:
    """What attaching ``files`` does: rows of ``files`` with ``outcome``.

    ``too_large`` beyond ``max_bytes``; with ``prevent_overwrite`` all but the
    first of a name, and names that are stored, ``exists``; ``noop`` where the
    stored object has the same digest; else ``stored``.
    """
    told = described(files)
    had = stored.select(*OWNER, "name", F.col("plaintext_sha256").alias("_had"))
    nth = F.row_number().over(Window.partitionBy(*OWNER, "name").orderBy(order))
    both = told.withColumn("_nth", nth).join(had, [*OWNER, "name"], "left")
    outcome = F.when(F.col("size") > max_bytes, "too_large") if max_bytes > 0 else F.when(F.lit(False), "")
    if prevent_overwrite:
        outcome = outcome.when((F.col("_nth") > 1) | F.col("_had").isNotNull(), "exists")
    outcome = outcome.when(F.col("_had") == F.col("plaintext_sha256"), "noop").otherwise("stored")
    return both.withColumn("outcome", outcome).drop("_nth", "_had")


def listing(stored: DataFrame, namespace: str, key: str) -> DataFrame:
    """The attachments of a key, without payloads."""
    return stored.where((F.col("namespace") == namespace) & (F.col("key") == key)).drop("payload")


def select(stored: DataFrame, name: str | None = None, attachment_id: str | None = None) -> DataFrame:
    """Attachments by name, by id, or by both."""
    if name is None and attachment_id is None:
        raise ValueError("a name or an id is required")
    out = stored if name is None else stored.where(F.col("name") == name)
    return out if attachment_id is None else out.where(F.col("id") == attachment_id)


def delete(stored: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left, and one row with ``deleted_count``. Without ``names(namespace, key, name)`` all go."""
    if names is None:
        return stored.limit(0), stored.agg(F.count(F.lit(1)).alias("deleted_count"))
    on = [*OWNER, "name"]
    return stored.join(names, on, "left_anti"), stored.join(names, on, "left_semi").agg(F.count(F.lit(1)).alias("deleted_count"))
