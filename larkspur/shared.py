"""Where tables that several jobs of one query share are written.

A cluster names a folder that driver and executors share in
``spark.checkpoint.dir``; only where that setting is absent and Spark runs on
one machine (tests) is a temporary folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it, an SQL execution removes its shuffle files when it ends; its result is then in the written table.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch, beside Spark's limit of rows: texts differ in length, and a task holds its batch on both sides.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Jobs begun in the block have Arrow batches that end at ``BATCH_BYTES``, after a whole row, and these settings."""
    wanted = {_BATCH: str(BATCH_BYTES)} | values
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    It cuts the lineage: lost executors cost no more than the job that is
    running, because what is written is outside them. Shuffle files of the
    write are removed when it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with settings(spark, **{_CLEAN: "true"}):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    if _open:
        _open[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these tables; nothing may read them any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete, at the end of the block, all tables written in it but for those put into the list it gives."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        discard(*(t for t in made if not any(t is k for k in kept)))
        if _open:
            _open[-1].extend(kept)
