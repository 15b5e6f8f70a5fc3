"""Media columns with content-defined chunking of their payload.

A payload is stored as a wave file of unsigned 8-bit samples. The file is cut
where a rolling gear hash of its last bytes meets a mask, so equal stretches
give equal chunks wherever they stand. Two tables hold everything:

* ``manifests``: for each row the ordered digests and sizes of its chunks, and
  the bytes of those chunks that occur nowhere else;
* ``chunks``: the bytes of every other chunk once, by digest.

Which chunks occur more than once is counted exactly over all rows, by digest
alone. What the writing tasks get of it is a filter of fixed size
(``FILTER_BITS``): a chunk it does not know is surely alone and stays with its
manifest; a chunk it knows goes to ``chunks``, where a join by digest leaves one
of it. A full filter costs traffic, never a result. So only chunks that are
shared move between machines, and no text does.

Reading joins the shared chunks back to the rows that list them, verifies
every chunk against its digest, joins them in order and checks the file's
SHA-256.

Defined cases: null counts as empty; an empty text has a payload of one unit
of blanks; payloads of any length are cut whole; repeated rows have manifests
of their own and share chunks; an empty table gives no rows; only the id and
text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.text_arrays import slices
from larkspur.shared import materialize

#: Payloads are padded with blanks to a multiple of this.
UNIT = 192
#: Bits that must be zero for a cut, and bounds of a chunk's size.
CUT_BITS, LEAST, MOST = 11, 512, 8192
FILTER_BITS = 1 << 24
SALTS = 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """A wave file whose samples are the bytes of the payload."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def samples(file: bytes) -> bytes:
    """The payload of a wave file made by :func:`wave`."""
    (n,) = struct.unpack_from("<I", file, 40)
    return file[44 : 44 + n]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a file. The gear hash of 32 bytes is built in five doublings."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    found = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1
    ends, at, i, n = [], 0, 0, len(data)
    while n - at > LEAST:
        i = int(np.searchsorted(found, at + LEAST))
        end = int(found[i]) if i < len(found) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def split(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


def _files(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    for text in texts:
        raw = (text or "").encode()
        yield len(raw), wave(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "))


def _place(d: bytes) -> int:
    return int.from_bytes(d[:8], "little") % FILTER_BITS


def feature(payload: bytes) -> str:
    """Mean, energy, zero crossings and an eight-bin histogram of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    bins = np.bincount((x + 128) >> 5, minlength=8)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / len(x):.4f};energy={int((x * x).sum()) / len(x):.4f};crossings={crossings};bins={'-'.join(map(str, bins.tolist()))}"


def _pack(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.input_stream(pa.py_buffer(data), compression="zstd").read()


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bits of the digests that occur more than once, in FILTER_BITS / 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(0)):
                found = [digest(c) for _, file in _files(batch.column(0).slice(begin, end - begin).to_pylist()) for c in split(file)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([_place(d) for d in found], pa.int64())], names=["digest", "place"])

    seen = docs.select("text").mapInArrow(run, "digest binary, place long")
    often = seen.groupBy("digest", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = often.groupBy(F.floor(F.col("place") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 32 AS int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in words.toLocalIterator():  # FILTER_BITS / 32 rows at most
        out[row["word"]] = row["bits"]
    return out


def _known(words: np.ndarray, d: bytes) -> bool:
    place = _place(d)
    return bool(words[place >> 5] >> np.uint32(place & 31) & np.uint32(1))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write ``manifests`` and ``chunks`` to the shared folder and return both as read back."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(shared_filter(source))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            source.schema["id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("file_sha256", T.StringType()),
            T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("shared", T.ArrayType(T.IntegerType())),
            T.StructField("own", T.BinaryType()),
        ]
    )

    def manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                rows: list[dict] = []
                texts = batch.column(1).slice(begin, end - begin).to_pylist()
                for id_value, (n, file) in zip(batch.column(0).slice(begin, end - begin), _files(texts), strict=True):
                    parts = split(file)
                    names = [digest(c) for c in parts]
                    common = [i for i, d in enumerate(names) if _known(bits.value, d)]
                    moved = set(common)
                    own = b"".join(c for i, c in enumerate(parts) if i not in moved)
                    rows.append({"row": row, "id": id_value.as_py(), "n_bytes": n, "file_sha256": hashlib.sha256(file).hexdigest(), "digests": names, "sizes": [*map(len, parts)], "shared": common, "own": _pack(own) if own else None})
                    row += 1
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(batch.column(0).type))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                found: dict[bytes, bytes] = {}  # a task's own copies leave it as few rows
                for _, file in _files(batch.column(1).slice(begin, end - begin).to_pylist()):
                    for c in split(file):
                        d = digest(c)
                        if d not in found and _known(bits.value, d):
                            found[d] = _pack(c)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])

    lists = materialize(source.mapInArrow(manifests, schema), "media-manifests")
    chunks = source.mapInArrow(common, "digest binary, bytes binary").groupBy("digest").agg(F.min("bytes").alias("bytes"))
    return lists, materialize(chunks, "media-chunks")


def _arrow_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("row", pa.int64()),
            ("id", id_type),
            ("n_bytes", pa.int64()),
            ("file_sha256", pa.string()),
            ("digests", pa.list_(pa.binary())),
            ("sizes", pa.list_(pa.int32())),
            ("shared", pa.list_(pa.int32())),
            ("own", pa.binary()),
        ]
    )


def load(lists: DataFrame, chunks: DataFrame, id_col: str = "doc_id", with_file: bool = False) -> DataFrame:
    """Rebuild and verify every file from its chunks.

    ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks, n_shared`` and, if asked for, ``file``.
    A chunk or file that does not have its digest ends the job with an error.
    """
    named = F.transform("shared", lambda i: F.struct(i.alias("i"), F.get("digests", i).alias("digest")))
    refs = lists.where(F.size("shared") > 0).select("row", F.inline(named)).select("row", "i", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    spread = refs.select("digest", "salt").distinct().join(chunks, "digest")
    moved = refs.join(spread, ["digest", "salt"]).groupBy("row").agg(F.collect_list(F.struct("i", "bytes")).alias("parts"))
    kind = "array<struct<i:int,bytes:binary>>"
    alone = lists.where(F.size("shared") == 0).withColumn("parts", F.lit(None).cast(kind))
    both = alone.unionByName(lists.where(F.size("shared") > 0).join(moved, "row").withColumn("parts", F.col("parts").cast(kind)))
    columns = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_chunks", T.IntegerType()), ("n_shared", T.IntegerType())]
    columns += [("file", T.BinaryType())] if with_file else []
    schema = T.StructType([T.StructField(id_col, lists.schema["id"].dataType), *(T.StructField(*c) for c in columns)])

    def rebuilt(digests: list[bytes], sizes: list[int], shared: list[int], own: bytes | None, parts: list[dict] | None) -> bytes:
        mine, at, out = _unpack(own) if own else b"", 0, []
        given = {p["i"]: p["bytes"] for p in parts or ()}
        common = set(shared)
        for i, (d, n) in enumerate(zip(digests, sizes, strict=True)):
            if i in common:
                chunk = _unpack(given[i])
            else:
                chunk = mine[at : at + n]
                at += n
            if digest(chunk) != d:
                raise ValueError("a chunk does not have its digest")
            out.append(chunk)
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in columns]
            lists_of = (batch.column(c).to_pylist() for c in ("n_bytes", "file_sha256", "digests", "sizes", "shared", "own", "parts"))
            for n, expected, digests, sizes, shared, own, parts in zip(*lists_of, strict=True):
                file = rebuilt(digests, sizes, shared, own, parts)
                name = hashlib.sha256(file).hexdigest()
                if name != expected:
                    raise ValueError("a file does not have its digest")
                payload = samples(file)
                row = [n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), name, feature(payload), len(sizes), len(shared), file]
                for column, value in zip(made, row, strict=False):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(made, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=schema.names)

    return both.mapInArrow(run, schema)
