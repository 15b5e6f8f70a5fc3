"""Document queries: namespace, selector, cursor, limit, projection, return mode.

A page is keyset-based: it holds keys after the cursor in key order, so pages
neither drift nor read what came before. The ``index`` engine reads the same
rows from a table whose hot fields are columns (see :func:`build_index`), and
must give the same result as ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import pointers
from larkspur.plans.selectors import Selector, SelectorError, typed

RETURN_MODES = ("documents", "keys", "compact")


@dataclass(frozen=True)
class Query:
    """A request; ``limit`` of 0 and an empty cursor mean none."""

    selector: str | dict
    namespace: str = "default"
    limit: int = 0
    cursor: str = ""
    fields: tuple[str, ...] = ()
    returns: str = "documents"
    engine: str = "scan"


def _visible(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.col("query_hidden"), F.lit(False))) if "query_hidden" in docs.columns else docs


def candidates(docs: DataFrame, query: Query, index: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """All documents of the namespace that the selector holds for, hidden ones left out."""
    if not query.selector:
        raise SelectorError("a selector is required")
    holds = Selector(index=index if query.engine == "index" else None).compile(query.selector)
    return _visible(docs).where(F.col("namespace") == query.namespace).where(holds)


def run(docs: DataFrame, query: Query, index: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """One page, by key: ``key, doc`` (documents), ``key`` (keys) or ``key, version`` (compact)."""
    if query.returns not in RETURN_MODES:
        raise ValueError(f"unknown return mode {query.returns}")
    found = candidates(docs, query, index)
    if query.cursor:
        found = found.where(F.col("key") > query.cursor)
    if query.limit > 0:
        found = found.orderBy("key").limit(query.limit)
    return found.select(*_columns(docs, query))


def _columns(docs: DataFrame, query: Query) -> list[Column | str]:
    if query.returns == "keys":
        return ["key"]
    if query.returns == "compact":
        return ["key", *(["version"] if "version" in docs.columns else [])]
    if not query.fields:
        return ["key", "doc"]
    known = [f for f in query.fields if f in docs.columns]
    inside = [F.get_json_object("doc", pointers.spark_path(f)).alias(f.strip("/").replace("/", "_")) for f in query.fields if f.startswith("/")]
    return [*known, *inside]


def metadata(docs: DataFrame, query: Query, index: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row: ``query_candidates`` (visible documents of the namespace), ``query_matches``, ``cursor`` (last key), ``return_mode``, ``index_seq``.

    ``index_seq`` is the last flush that a stored index holds; null for a scan.
    """
    return metadata_each(docs, [query], index).drop("query")


def metadata_each(docs: DataFrame, queries: list[Query], index: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """As :func:`metadata`, a row for each query of one namespace with its number as ``query``; the documents are read one time."""
    (namespace,) = {q.namespace for q in queries}
    told = []
    for i, query in enumerate(queries):
        holds = Selector(index=index if query.engine == "index" else None).compile(query.selector)
        one = F.struct(
            F.lit(i).alias("query"),
            F.count(F.lit(1)).alias("query_candidates"),
            F.count_if(holds).alias("query_matches"),
            F.max(F.when(holds, F.col("key"))).alias("cursor"),
            F.lit(query.returns).alias("return_mode"),
            (F.max("index_seq") if query.engine == "index" and "index_seq" in docs.columns else F.lit(None).cast("long")).alias("index_seq"),
        )
        told.append(one)
    rows = _visible(docs).where(F.col("namespace") == namespace)
    return rows.agg(F.array(*told).alias("told")).select(F.inline("told"))


def pages(docs: DataFrame, query: Query, index: Mapping[str, tuple[str, str]] | None = None) -> Iterator[DataFrame]:
    """Pages until one comes back short; each is read when asked for."""
    while True:
        page = run(docs, replace(query, returns="keys"), index)
        last = page.agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if not last["n"]:
            return
        yield run(docs, query, index)
        if not query.limit or last["n"] < query.limit:
            return
        query = replace(query, cursor=last["last"])


def stream_keys(keys: DataFrame, begin: Callable[[], None], chunk: Callable[[str], None], end: Callable[[], None]) -> int:
    """Hand every key to a handler, partition by partition; an exception of the handler ends it."""
    begin()
    n = 0
    for row in keys.select("key").toLocalIterator(prefetchPartitions=True):
        chunk(row["key"])
        n += 1
    end()
    return n


def keys_envelope(page: DataFrame) -> DataFrame:
    """A page of keys as one row: ``keys`` in order and the ``cursor`` to go on from."""
    return page.agg(F.array_sort(F.collect_list("key")).alias("keys"), F.max("key").alias("cursor"))


def build_index(docs: DataFrame, fields: Iterable[tuple[str, str]]) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """``docs`` with a typed column for each (pointer, type), and the mapping that selectors read."""
    mapping, out = {}, docs
    for field, kind in fields:
        name = "ix_" + "_".join(pointers.parse(field))
        out = out.withColumn(name, typed(F.try_variant_get(F.try_parse_json("doc"), pointers.spark_path(field), "variant"), kind))
        mapping[field] = (name, kind)
    return out, mapping


def write_index(indexed: DataFrame, path: str, index_seq: int = 0) -> None:
    """Write an index table by namespace, sorted by key, so keyset pages skip row groups; every row has the flush it was written by."""
    indexed.withColumn("index_seq", F.lit(index_seq).cast("long")).repartitionByRange("namespace", "key").sortWithinPartitions("namespace", "key").write.mode("overwrite").partitionBy("namespace").parquet(path)


def refresh(spark: SparkSession, path: str) -> None:
    """Forget what is cached of a table's files, so the next query reads what was written last."""
    spark.catalog.refreshByPath(path)
