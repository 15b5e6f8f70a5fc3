"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. *Document frequency* of five-word shingles over all documents, in a sketch
   of fixed size: counts by hash cell, from which the mean cell is taken off.
   What remains estimates how many documents hold a frequent shingle.
2. *Signatures*: a shingle weighs (1 + ln tf) * ln(1 + N / (2 N + df)). The
   weight falls with df but stays within a factor of 1.4, because the shingles
   of a large group of near copies are frequent by being copied, and a steep
   weight would pull their similarity down. Improved consistent weighted
   sampling (Ioffe 2010) draws BANDS x ROWS samples, equal with the
   probability of the weighted Jaccard similarity.
3. *Buckets*: texts that agree in all rows of a band share a bucket.
4. *Verification*: pairs of a bucket are linked when their weighted Jaccard
   similarity, from whole texts, is ``threshold`` or more. To avoid all pairs
   of a bucket, rounds first compare all members with one leader and merge
   what is linked; a later round only looks at buckets that still hold
   several classes, under another leader. After ``LEADER_ROUNDS`` of these,
   the members outside a bucket's largest class are the queries of a search
   over the whole bucket, in blocks of bounded size on both sides, so no link
   between classes is lost and no table of pairs is made.
5. *Classes* are the connected components of links.

Equal texts are collapsed first, and every class is named by its least id.

Defined cases: null counts as empty; texts without a word have no shingles
and are only classed with equal texts; texts of one to four words have one
shingle, all of them; long texts are read whole; repeated rows are in one
class; a null id never names a class that has another id; an empty table
gives no rows; working columns carry the prefix ``_nd_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import count_blocks
from larkspur.llm.components import components
from larkspur.llm.skew import SALTS, spread_join
from larkspur.llm.text_arrays import Words, mix, slices, text_bytes
from larkspur.shared import materialize

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Cells of the document-frequency sketch, and the size of the table of random draws.
CELLS, DRAWS = 1 << 18, 1 << 16
LEADER_ROUNDS = 4
#: Queries and members of a bucket that meet in one group of the last search, about.
QUERY_BLOCK, MEMBER_BLOCK = 256, 512

#: Shingles that are sampled at once.
_CHUNK = 1 << 16

_K = np.uint64(0xD1342543DE82EF95)
_random = np.random.default_rng(7)
_R = (-np.log(_random.random(DRAWS) * _random.random(DRAWS))).clip(1e-4).astype(np.float32)
_LN_C = np.log((-np.log(_random.random(DRAWS) * _random.random(DRAWS))).clip(1e-9)).astype(np.float32)
_BETA = _random.random(DRAWS).astype(np.float32)
_FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row, hash and how often, by row and hash."""
    words = Words(*text_bytes(column))
    n, counts = len(words), words.counts
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.minimum(counts, SHINGLE)
    begins = np.cumsum(counts) - counts
    at = np.arange(n)
    starts = at - begins[words.doc] <= (counts - size)[words.doc]
    at = at[starts]
    row = words.doc[at]
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words.hash, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        value = np.where(k < size[row], value * _K + padded[at + k], value)
    value = mix(value + size[row].astype(np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.append(first, len(row)))


@dataclass(frozen=True)
class Frequency:
    """Sketch of document frequencies over ``documents`` documents."""

    cells: np.ndarray
    documents: int

    def weight(self, hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
        n = max(self.documents, 1)
        above = self.cells[(hashes >> np.uint64(46)).astype(np.int64)] - self.cells.mean()
        return ((1 + np.log(often)) * np.log1p(n / (2 * n + np.clip(above, 0, n)))).astype(np.float32)


def document_frequency(docs: DataFrame, text_col: str = "text") -> Frequency:
    """Count all documents' shingles; tasks emit blocks of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            total[CELLS] += len(batch)
            for begin, end in slices(batch.column(0)):
                hashes = shingles(batch.column(0).slice(begin, end - begin))[1]
                total[:CELLS] += np.bincount((hashes >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        yield from count_blocks.emit({"df": total})

    rows = docs.select(F.col(text_col).alias("_nd_text")).mapInArrow(run, count_blocks.SCHEMA)
    found = count_blocks.to_arrays(count_blocks.total(rows), CELLS + 1).get("df", np.zeros(CELLS + 1, np.int64))
    return Frequency(found[:CELLS], int(found[CELLS]))


def band_keys(column: pa.Array, frequency: Frequency) -> np.ndarray:
    """Bucket keys of each text, rows x BANDS; texts without shingles get a row of zeros."""
    row, hashes, often = shingles(column)
    out = np.zeros((len(column), BANDS), np.uint64)
    if not len(row):
        return out
    some, number = np.unique(row, return_inverse=True)
    samples = np.full((BANDS * ROWS, len(some)), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(row), _CHUNK):
        part = slice(at, at + _CHUNK)
        here = number[part]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        texts = slice(int(here[0]), int(here[-1]) + 1)
        ln_w, low = np.log(frequency.weight(hashes[part], often[part])), hashes[part] & np.uint64(0xFFFFFFFF)
        for k, factor in enumerate(_FACTORS):
            draw = ((hashes[part] * factor) >> np.uint64(48)).astype(np.int64)
            r, beta = _R[draw], _BETA[draw]
            t = np.floor(ln_w / r + beta)
            ln_a = _LN_C[draw] - r * (t - beta + np.float32(1))
            bits = ln_a.view(np.int32)
            # order of floats as order of unsigned numbers; the shingle below them names the sample
            sortable = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64)
            least = np.minimum.reduceat(sortable << np.uint64(32) | low, first)
            samples[k, texts] = np.minimum(samples[k, texts], least)
    for band in range(BANDS):
        key = np.full(len(some), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * _K + samples[k])
        out[some, band] = key
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of largest weights of two shingle sets (sorted hashes, weights)."""
    _, at, of = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][at], b[1][of]).sum(dtype=np.float64))
    both = float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - least
    return least / both if both else 0.0


def _parsed(packed: bytes, frequency: Frequency) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and weights of a packed text."""
    text = pa.input_stream(pa.py_buffer(packed), compression="zstd").read()
    _, hashes, often = shingles(pa.array([text], pa.binary()))
    return hashes, frequency.weight(hashes, often)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _id_text(id_value: Column) -> Column:
    return F.coalesce(id_value.cast("string"), F.lit("null"))


def _signatures(docs: DataFrame, frequency: Frequency, id_col: str, text_col: str) -> DataFrame:
    """Digest and bands of every row, with a salt that deals equal rows evenly once it is written."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    source = docs.select(F.col(id_col).alias("_nd_id"), _digest(F.col(text_col)).alias("node"), F.coalesce(text_col, F.lit("")).alias("_nd_text"))
    schema = T.StructType([source.schema["_nd_id"], source.schema["node"], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("salt", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            salts = ((np.arange(len(batch)) + done) % SALTS).astype(np.int32)
            done += len(batch)
            made = [np.zeros((0, BANDS), np.uint64)]
            for begin, end in slices(batch.column(2)):
                made.append(band_keys(batch.column(2).slice(begin, end - begin), shared.value))
            keys = np.concatenate(made).view(np.int64)
            filled = keys.any(axis=1)
            offsets = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, keys[filled].ravel()), pa.array(salts)], names=schema.names)

    return source.mapInArrow(run, schema)


def _pack(texts: DataFrame) -> DataFrame:
    """``node, packed``: candidate texts, compressed, as they travel in every round."""
    schema = T.StructType([texts.schema["node"], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                packed = [pa.compress(t.encode(), "zstd", asbytes=True) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, frequency: Frequency, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; the pairs of one leader b are dealt over tasks."""
    shared = pairs.sparkSession.sparkContext.broadcast(frequency)
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, tuple] = (b"", ())
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last[0] != b:  # a leader's pairs often stand together
                    last = (b, _parsed(text_b, shared.value))
                keep.append(weighted_jaccard(_parsed(text_a, shared.value), last[1]) >= threshold)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=schema.names)

    return spread_join(pairs.join(left, "a"), right, "b", "a").select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after new links between labelled nodes."""
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    lifted = links.join(at("a"), "a").join(at("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    higher = components(materialize(lifted, "lifted-links")).withColumnRenamed("label", "higher").withColumnRenamed("node", "label")
    return materialize(labels.join(higher, "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "node-labels")


def _leader_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Members of buckets with several classes, each with the bucket's leader of this turn."""
    order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "label")
    open_ones = placed.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(order).alias("leader"))
    open_ones = open_ones.where("least != most").select("bucket", F.col("leader.node").alias("b"), F.col("leader.label").alias("of"))
    return spread_join(placed, open_ones, "bucket", "node").where(F.col("label") != F.col("of")).select(F.col("node").alias("a"), "b").distinct()


def _searched(placed: DataFrame, texts: DataFrame, frequency: Frequency, threshold: float) -> DataFrame:
    """Links (a, b) between classes that the leaders did not find.

    A pair is compared in the first band both texts share, and a query that is
    linked to a class is not compared with more of that class in its group.
    Buckets of two were settled by their leader.
    """
    shared = placed.sparkSession.sparkContext.broadcast(frequency)
    sizes = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.groupBy("bucket").agg(F.sum("n").alias("m"), F.max("n").alias("largest"), F.max_by("label", F.struct("n", "label")).alias("big"))
    stats = stats.where("m > largest and m > 2").select("bucket", "big", F.ceil((F.col("m") - F.col("largest")) / QUERY_BLOCK).cast("int").alias("queries"), F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("blocks"))
    inside = placed.join(stats, "bucket")
    spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = inside.select("bucket", "node", "label", spot("blocks", 1).alias("mb"), every("queries").alias("qb"))
    queries = inside.where(F.col("label") != F.col("big")).select("bucket", "node", "label", spot("queries", 2).alias("qb"), every("blocks").alias("mb"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def bands(table: pa.Table) -> np.ndarray:
        return table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: tuple[list[bytes], list[bytes]] = ([], [])
        if len(asked) and len(held):
            nodes, packed, labels, keys = held["node"].to_pylist(), held["packed"].to_pylist(), held["label"].to_pylist(), bands(held)
            here = int(np.flatnonzero(keys[0] == held["bucket"][0].as_py())[0])
            parsed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for node, text, label, key in zip(asked["node"].to_pylist(), asked["packed"].to_pylist(), asked["label"].to_pylist(), bands(asked), strict=True):
                mine, done = _parsed(text, shared.value), {label}
                for i in np.flatnonzero((keys == key).argmax(axis=1) == here).tolist():
                    if labels[i] in done:
                        continue
                    if i not in parsed:
                        parsed[i] = _parsed(packed[i], shared.value)
                    if weighted_jaccard(mine, parsed[i]) >= threshold:
                        done.add(labels[i])
                        found[0].append(node)
                        found[1].append(nodes[i])
        return pa.table([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=schema.names)

    on, columns = ["bucket", "mb", "qb"], ["bucket", "mb", "qb", "node", "label", "packed", "bands"]
    # columns of their own for both sides, which come from the same tables
    asked, held = (side.join(texts, "node").select(columns).toDF(*columns) for side in (queries, members))
    return asked.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(search, schema)


def _label_nodes(members: DataFrame, texts: DataFrame, frequency: Frequency, threshold: float) -> DataFrame:
    """``node, label`` of all candidate nodes, by leader rounds and then a search of what they left."""
    labels = materialize(members.select("node", F.col("node").alias("label")).distinct(), "node-labels")
    for turn in range(LEADER_ROUNDS):
        pairs = materialize(_leader_pairs(members.join(labels, "node"), turn), "pairs")
        if pairs.isEmpty():
            return labels
        links = materialize(_verified(pairs, texts.drop("bands"), frequency, threshold), "links")
        if not links.isEmpty():
            labels = _merge(labels, links)
    links = materialize(_searched(members.join(labels, "node"), texts, frequency, threshold), "links")
    return labels if links.isEmpty() else _merge(labels, links)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: ``id_col, class_id`` (least id of the class), ``class_size``."""
    return _classed(docs, id_col, text_col, threshold).drop("node", "label")


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """As :func:`classes`, with the digest of each text as ``node`` and the class's own ``label``."""
    frequency = document_frequency(docs, text_col)
    signed = materialize(_signatures(docs, frequency, id_col, text_col), "signatures")
    nodes = materialize(signed.groupBy("node").agg(F.min("_nd_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared_buckets = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialize(spread_join(exploded, shared_buckets, "bucket", "node").select("bucket", "node"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", _id_text(F.col("first_id")).alias("_nd_key"))
    source = docs.select(_digest(F.col(text_col)).alias("node"), _id_text(F.col(id_col)).alias("_nd_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    # by text and id, so the copies of one text do not meet in one task
    found = source.join(wanted, ["node", "_nd_key"], "left_semi").dropDuplicates(["node", "_nd_key"]).select("node", "text")
    texts = materialize(_pack(found).join(nodes.select("node", "bands"), "node"), "candidates")
    labels = _label_nodes(members, texts, frequency, threshold)
    named = nodes.join(labels, "node", "left").select("node", "first_id", "copies", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    of_node = named.select("node", "label").join(ids, "label").select("node", "label", "class_id", "class_size")
    light = signed.select(F.col("_nd_id").alias(id_col), "node", F.col("salt").alias("_nd_salt"))
    return spread_join(light, of_node, "node", F.col("_nd_salt")).select(id_col, "class_id", "class_size", "node", "label")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the least id of every class, as it was; repeated rows leave one.

    Where rows of a class share that id, the one whose text has the least digest stays.
    """
    named = _classed(docs, "doc_id", "text", threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = named.groupBy("label", _id_text(F.col("doc_id")).alias("_nd_key")).agg(F.min("node").alias("_nd_node"))
    keyed = docs.withColumn("_nd_key", _id_text(F.col("doc_id"))).withColumn("_nd_node", _digest(F.col("text")))
    return keyed.join(first, ["_nd_key", "_nd_node"], "left_semi").dropDuplicates(["_nd_key", "_nd_node"]).select(docs.columns)
