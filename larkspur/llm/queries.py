"""The queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import brown_lm, chat_format, exact_dedup, language_id, media_chunks, near_dedup, packing, piece_fst, secrets, token_counts

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_documents(spark, sf_dir).select("doc_id", "text"), folds=5, fold=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(BYTE_BPE), limit=512)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=0, longest=1024)
    return packed.select("doc_id", "start", "length", packing.with_checksum(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = piece_fst.encode(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(PIECES), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", piece_fst.round_trips("text", "decoded").alias("round_trip"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_spans(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.STRONG))
    each = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in secrets.STRONG]
    return found.select("doc_id", *each, F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, chunks = media_chunks.store(_documents(spark, sf_dir).select("doc_id", "text"))
    return media_chunks.load(lists, chunks)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_strings(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.digests(chat_format.windows(turns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_lm": op1_brown_lm,
        "op2_token_counts": op2_token_counts,
        "op3_packing": op3_packing,
        "op4_piece_fst": op4_piece_fst,
        "op5_secrets": op5_secrets,
        "op6_media_chunks": op6_media_chunks,
        "op7_chat_format": op7_chat_format,
        "op8_near_dedup": op8_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
                 g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g USING (norm)""",
    }
