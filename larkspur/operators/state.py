"""Versioned state documents: latest view, history, conditional writes, tombstones.

``state_versions(namespace, key, version, state_etag, doc, committed, removed,
query_hidden, updated_at_unix, ...)`` only grows; every write appends a version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.mutate import mutate
from larkspur.plans.mutations import Step

KEY = ("namespace", "key")


def etag(doc: Column) -> Column:
    """The tag of a document's text."""
    return F.sha2(doc.cast("binary"), 256)


def latest(versions: DataFrame, public: bool = True) -> DataFrame:
    """The last version of every key; ``public`` sees committed versions only. Tombstones are gone.

    An aggregate, not a window: it combines before the shuffle, so a key with
    many versions sends one row from each task.
    """
    out = newest(versions.where("committed") if public and "committed" in versions.columns else versions)
    return out.where(~F.coalesce(F.col("removed"), F.lit(False))) if "removed" in versions.columns else out


def newest(versions: DataFrame) -> DataFrame:
    """The row with the highest version of every key, tombstones with the others."""
    rest = [c for c in versions.columns if c not in KEY]
    return versions.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col("version")).alias("_last")).select(*KEY, "_last.*")


def of_keys(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the keys in ``keys(namespace, key, ...)``.

    For rows before :func:`history`: Spark does not move the join below the
    numbering, so versions of all keys would be sorted for it. A task keeps its
    distinct keys in a hash table and lets the rows pass it, where a merge join
    would sort the rows of all keys.
    """
    return versions.join(keys.select(*KEY).distinct().hint("shuffle_hash"), list(KEY), "left_semi")


def get(versions: DataFrame, key: str, namespace: str = "default", public: bool = True) -> DataFrame:
    """The document of one key; no row where there is no content."""
    return latest(versions.where((F.col("namespace") == namespace) & (F.col("key") == key)), public)


def history(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the writes of each key from 1."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)).cast("long"))


def load(docs: DataFrame, schema: T.StructType, doc_col: str = "doc", strict: bool = True) -> DataFrame:
    """Typed fields of the documents beside their other columns."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return docs.withColumn("_typed", F.from_json(doc_col, schema, mode)).select(*[c for c in docs.columns if c != doc_col], "_typed.*")


def save(rows: DataFrame, fields: list[str], doc_col: str = "doc") -> DataFrame:
    """``rows`` with the named columns written as a JSON document."""
    return rows.withColumn(doc_col, F.to_json(F.struct(*fields))).drop(*[f for f in fields if f not in KEY])


def check_writes(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes`` with ``current_version``, ``exists`` and ``conflict``.

    A write names ``if_version`` and ``if_state_etag`` (null: no condition,
    and an empty etag is none). A key without versions has version 0. A
    tombstone is a version like any other, so what is written after a remove
    stands above it; it has no etag. Of several writes of a batch to one key
    that meet their conditions, one is made (the least ``write_id``, where
    there is such a column, then the least document); the others are conflicts.
    """
    gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in versions.columns else F.lit(False)
    now = newest(versions.select(*KEY, "version", "state_etag", gone.alias("removed")))
    now = now.select(*KEY, F.col("version").alias("current_version"), F.when(~F.col("removed"), F.col("state_etag")).alias("current_etag"), (~F.col("removed")).alias("exists"))
    both = writes.join(now, list(KEY), "left").withColumn("current_version", F.coalesce("current_version", F.lit(0).cast("long"))).withColumn("exists", F.coalesce("exists", F.lit(False)))
    wrong_version = F.coalesce(F.col("if_version") != F.col("current_version"), F.lit(False))
    wanted = F.nullif(F.col("if_state_etag"), F.lit(""))
    wrong_etag = wanted.isNotNull() & ~wanted.eqNullSafe(F.col("current_etag"))
    order = [c for c in ("write_id", "doc") if c in writes.columns] or [F.lit(0)]
    nth = F.row_number().over(Window.partitionBy(*KEY, "_wrong").orderBy(*order))
    return both.withColumn("_wrong", wrong_version | wrong_etag).withColumn("conflict", F.col("_wrong") | (nth > 1)).drop("_wrong")


def update(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """The versions that the writes without conflict append: ``doc`` whole, version + 1."""
    good = check_writes(versions, writes).where(~F.col("conflict"))
    return good.select(*KEY, (F.col("current_version") + 1).alias("version"), etag(F.col("doc")).alias("state_etag"), "doc", F.octet_length("doc").cast("long").alias("bytes"))


def remove(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """Tombstones for the keys of the writes: ``removed`` says whether there was state."""
    good = check_writes(versions, writes).where(~F.col("conflict"))
    return good.select(*KEY, (F.col("current_version") + 1).alias("version"), F.lit(None).cast("string").alias("doc"), F.col("exists").alias("removed"))


def set_hidden(versions: DataFrame, marks: DataFrame) -> DataFrame:
    """Latest rows with ``query_hidden`` taken from ``marks`` where it has the key and a value."""
    new = marks.select(*KEY, F.col("query_hidden").alias("_hidden"))
    return latest(versions, public=False).join(new, list(KEY), "left").withColumn("query_hidden", F.coalesce("_hidden", "query_hidden")).drop("_hidden")


def describe(versions: DataFrame) -> DataFrame:
    """Metadata of every key, without reading a document."""
    columns = [c for c in ("version", "state_etag", "query_hidden", "updated_at_unix", "removed", "committed") if c in versions.columns]
    return latest(versions.select(*KEY, *columns))


def mutate_local(versions: DataFrame, keys: DataFrame, plan: list[Step], fetched_cas: bool = True) -> DataFrame:
    """The versions that a plan appends to ``keys(namespace, key)``: read, rewrite, write.

    A key without content begins as ``{}``. With ``fetched_cas`` the version and
    etag that were read become the condition of the write.
    """
    now = latest(versions, public=False).select(*KEY, "doc", "version", "state_etag")
    read = keys.select(*KEY).join(now, list(KEY), "left")
    condition = F.when(F.lit(fetched_cas) & (F.col("version") > 0), F.col("version"))
    tag = F.when(F.lit(fetched_cas), F.col("state_etag"))
    made = mutate(read, plan).select(*KEY, "doc", condition.alias("if_version"), tag.alias("if_state_etag"))
    return update(versions, made)
