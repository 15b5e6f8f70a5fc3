"""Byte sources and sinks as DataFrames, and the copy between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def from_memory(spark: SparkSession, items: Iterable[bytes]) -> DataFrame:
    """One ``content`` row for each item."""
    return spark.createDataFrame([(bytearray(i),) for i in items], "content binary")


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row for each file: ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One ``value`` row for each file, whole."""
    return spark.read.text(path, wholetext=True)


def ndjson(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


class CallbackSource(DataSource):
    """Rows pulled from a function: ``spark.read.format("callback")``.

    The option ``factory`` names it as ``module:function``; it is called with
    the partition number in the task and yields bytes until it is done.
    """

    @classmethod
    def name(cls) -> str:
        return "callback"

    def schema(self) -> str:
        return "part int, seq long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CallbackReader(self.options)


class CallbackReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.factory, self.parts = options["factory"], int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.factory.partition(":")
        for seq, data in enumerate(getattr(import_module(module), name)(partition.value)):
            yield partition.value, seq, bytearray(data)


def from_callback(spark: SparkSession, factory: str, partitions: int = 1) -> DataFrame:
    """Rows of a :class:`CallbackSource`."""
    spark.dataSource.register(CallbackSource)
    return spark.read.format("callback").option("factory", factory).option("partitions", partitions).load()


def to_files(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write as parquet, json or text; parts are written where they are."""
    df.write.mode("overwrite").format(kind).save(path)


def to_memory(df: DataFrame, limit_bytes: int = 100 << 20) -> list[bytes]:
    """All contents on the driver, partition by partition; an error beyond the limit."""
    out, size = [], 0
    for row in df.select("content").toLocalIterator():
        size += len(row["content"])
        if size > limit_bytes:
            raise ValueError("the contents exceed the limit")
        out.append(bytes(row["content"]))
    return out


def to_callback(df: DataFrame, write: Callable[[bytes], None]) -> None:
    """Hand every content to ``write`` in the tasks; its exceptions end the job."""

    def each(rows: Iterator) -> None:
        for row in rows:
            write(bytes(row["content"]))

    df.select("content").foreachPartition(each)


def copy(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write contents and return one row with ``written``, the bytes that arrived."""
    to_files(df, path, kind)
    return df.sparkSession.read.format(kind).load(path).agg(F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("written"))
