"""A corpus pipeline: stages over ``documents``, each written before the next reads it.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. All but the last return the columns of ``documents``:

1. language ID: documents without a recognised language go;
2. exact dedup: of equal texts the least doc_id stays;
3. MinHash near-dedup: of each near-duplicate class the least doc_id stays;
4. secret scan: every reported span is replaced by its kind in brackets;
5. packing: pieces of power-of-two length, each a sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, language_id, near_dedup, packing, secrets
from larkspur.shared import discard, materialize, scratch

VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model is learnt from the same table. Odd rows: see :mod:`larkspur.llm.language_id`."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id. Odd rows: see :mod:`larkspur.llm.exact_dedup`."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate class the row with the least id. Odd rows: see :mod:`larkspur.llm.near_dedup`."""
    return near_dedup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; none is dropped. Odd rows: see :mod:`larkspur.llm.secrets`."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with a checksum in place of its ids. Odd rows: see :mod:`larkspur.llm.packing`."""
    made = packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=0, longest=1024)
    return made.select("doc_id", "start", "length", packing.with_checksum(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL cannot express naive Bayes, sampling and tokenizers; tests/llm/test_pipeline_brute.py compares with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
