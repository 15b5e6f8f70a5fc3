"""Exact deduplication by salted digest groups (DataFrame functions only).

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]``
became one space; a null text counts as empty. Three stages, and each groups
by the full content beside its digest, so two texts that share a digest are
never merged:

1. inside every map task (Spark's partial aggregation), so a group of copies
   leaves a task as one row, whatever its size;
2. by digest, content and salt (the map task's number), which spreads what
   the map tasks found of a hot group over ``salts`` tasks;
3. by digest and content over the salt winners.

Only ids, digests and salts, no texts, go through the join that gives every
document its group; should two contents ever share a digest that join could not tell
them apart, so the query stops with an error instead of guessing.

Defined cases: null and empty texts are one group; rows with the same doc_id
and equal text (repeated rows) are counted apart in ``group_size`` and share
their group's answer, and :func:`keep_first` leaves one of them; a null
doc_id stays only where its group has no other id; an empty table gives no
rows; other columns are kept by :func:`keep_first` and never clash, for
working columns carry the prefix ``_xd_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Tasks that the rows of one group are spread over in the second stage.
SALTS = 16


def normalized(text: Column) -> Column:
    """The text with each white-space run as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(content: Column) -> Column:
    """SHA-256 of a content in UTF-8 as lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct content: ``_xd_digest, keep_id, group_size``."""
    content = docs.select(
        F.col(id_col).alias("_xd_id"),
        normalized(F.col(text_col)).alias("_xd_text"),
        (F.spark_partition_id() % salts).alias("_xd_salt"),
    )
    salted = (
        content.withColumn("_xd_digest", digest(F.col("_xd_text")))
        .groupBy("_xd_digest", "_xd_salt", "_xd_text")
        .agg(F.min("_xd_id").alias("_xd_first"), F.count(F.lit(1)).alias("_xd_n"))
    )
    whole = salted.groupBy("_xd_digest", "_xd_text").agg(F.min("_xd_first").alias("keep_id"), F.sum("_xd_n").alias("group_size"))
    alone = F.count(F.lit(1)) == 1
    return whole.groupBy("_xd_digest").agg(
        F.when(alone, F.min("keep_id")).otherwise(F.raise_error(F.lit("two contents share a digest"))).alias("keep_id"),
        F.min("group_size").alias("group_size"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every document, dropped ones too, with the group it belongs to.

    Returns ``id_col, keep_id, group_size long, kept boolean, text_sha256``.
    """
    light = docs.select(
        F.col(id_col).alias("_xd_id"),
        digest(normalized(F.col(text_col))).alias("_xd_digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("_xd_salt"),
    )
    # the winner of a group meets its members in as many tasks as the group has salts
    best = light.select("_xd_digest", "_xd_salt").distinct().join(winners(docs, id_col, text_col, salts), "_xd_digest")
    return light.join(best, ["_xd_digest", "_xd_salt"]).select(
        F.col("_xd_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_xd_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_xd_digest").alias("text_sha256"),
    )


def _row_key(id_value: Column, content_digest: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_value.cast("string"), F.lit("null")), content_digest)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns.

    Repeated rows (same id, equal text) leave one row. The join key holds id
    and digest, so the rows of a hot group spread over all tasks.
    """
    best = winners(docs, id_col, text_col, salts).select(_row_key(F.col("keep_id"), F.col("_xd_digest")).alias("_xd_key"))
    tagged = docs.withColumn("_xd_key", _row_key(F.col(id_col), digest(normalized(F.col(text_col)))))
    return tagged.join(best, "_xd_key", "left_semi").dropDuplicates(["_xd_key"]).select(docs.columns)
