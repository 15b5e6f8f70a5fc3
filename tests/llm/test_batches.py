import numpy as np
import pyarrow as pa

from larkspur.llm import count_blocks
from larkspur.shared import BATCH_BYTES, materialize

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_tasks_get_texts_in_batches_of_bounded_size(spark):
    docs = spark.range(0, 60, 1, 1).selectExpr("repeat(cast(id as string), 250000) as text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "size"])

    def count(batches):
        yield from count_blocks.emit({"rows": np.array([max(len(b) for b in batches)])})

    before = spark.conf.get(LIMIT, None)
    seen = materialize(docs.mapInArrow(run, "n long, size long"), "batches").collect()
    assert sum(r.n for r in seen) == 60 and max(r.size for r in seen) < BATCH_BYTES + 1_000_000
    most = count_blocks.to_arrays(count_blocks.total(docs.mapInArrow(count, count_blocks.SCHEMA)), 1)
    assert 0 < most["rows"][0] < 30
    assert spark.conf.get(LIMIT, None) == before
