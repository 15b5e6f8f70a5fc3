import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.shared import materialize


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], data), f"test-{name}"))
    return out


def test_stages_keep_the_columns(stages):
    for frame in stages[:-1]:
        assert frame.columns == stages[0].columns


def test_each_stage_only_drops_what_it_should(stages):
    docs, spoken, exact, near, clean, _ = stages
    gone = docs.join(spoken.select("doc_id"), "doc_id", "left_anti")
    assert gone.where(F.col("text").rlike(r"\p{L}{3,} \p{L}{3,} \p{L}{3,}")).count() == 0
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    want = {r.k for r in spoken.groupBy(norm.alias("n")).agg(F.min("doc_id").alias("k")).collect()}
    assert {r.doc_id for r in exact.collect()} == want
    from larkspur.llm import near_dedup

    classes = near_dedup.classes(exact).collect()
    assert {r.doc_id for r in near.collect()} == {r.class_id for r in classes}
    before = {r.doc_id: r.text for r in near.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys()
    from larkspur.llm import secrets

    for i, text in before.items():
        spans = secrets.base_spans(text)
        assert not secrets.base_spans(after[i])
        if not spans and not secrets.weak_spans(text):
            assert after[i] == text


def test_packing_covers_every_document(stages):
    clean, packed = stages[4], stages[5]
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in sums)
    assert {r.doc_id for r in sums} == {r.doc_id for r in clean.collect()}


def test_run_gives_the_same_rows(spark, data, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, data).select(columns).collect()))
    assert got == sorted(map(tuple, stages[-1].select(columns).collect()))


def test_empty_and_odd_input(spark, data, odd):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = odd.withColumn("n_chars", F.length("text").cast("long")).select(names)
    for docs in (odd.limit(0), odd):
        frame = docs
        for name, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, data), f"odd-{name}")
        assert (frame.count() == 0) == (docs.count() == 0)
