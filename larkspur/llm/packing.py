"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then the end id) is cut into pieces whose
lengths are the binary digits of n, with as many pieces of the longest length
as fit, longest first. A piece of length 2^k is a sequence of bucket k: no
sequence crosses documents, and none is padded, as all sequences of a bucket
have one length. A training run draws each batch from one bucket.

Token ids come from the vocabulary's own library, once for each distinct
pre-token a worker meets; byte-level BPE never merges across pre-tokens, so
joining their ids gives the ids of the text.

Defined cases: a null or empty text is the end id alone, one piece of length
1; texts of any length are cut whole; repeated rows get pieces and sequences
of their own; an empty table gives no rows; of the input only the id column is
returned, so extra columns cannot clash. ``sequence_id`` is the partition of
the scan and a running number in it, so a task that runs again after a lost
executor gives the same ids. No shuffle.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from larkspur.llm.pretokens import pieces
from larkspur.llm.text_arrays import slices

#: Distinct pre-tokens whose ids one Python worker keeps at most, in two generations.
KEPT = 1_000_000
#: Bytes of text whose pre-tokens are looked up together.
SLICE_BYTES = 1 << 20
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class PieceIds:
    """Ids of texts, from the library, with the ids of known pre-tokens kept."""

    def __init__(self, vocabulary_json: str) -> None:
        self.library = Tokenizer.from_str(vocabulary_json)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.special = next((t.content for t in added.values()), "")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts, counts = pieces(texts, self.special)
        if len(self.known) > KEPT // 2:  # what stays in use moves to the new generation
            self.known, self.older = {}, self.known
        found: list[bytes | None] = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self._learn({parts[i] for i in missing})
            for i in missing:
                found[i] = self.known[parts[i]]
        out, at = [], 0
        for n in counts.tolist():
            out.append(b"".join(found[at : at + n]))
            at += n
        return out

    def _learn(self, parts: set[str]) -> None:
        known, older = self.known, self.older
        new = []
        for p in parts:
            ids = older.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        for p, made in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[p] = array("I", made.ids).tobytes() if _LITTLE else np.array(made.ids, "<u4").tobytes()


def piece_lengths(n: int, longest: int = 1024) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest, falling."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


SCHEMA = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

_made: dict[str, PieceIds] = {}


def _library(vocabulary_json: str) -> PieceIds:
    if vocabulary_json not in _made:
        _made.clear()
        _made[vocabulary_json] = PieceIds(vocabulary_json)
    return _made[vocabulary_json]


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, longest: int = 1024) -> DataFrame:
    """One row for each piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset, bucket``.

    ``ids`` holds little-endian unsigned 32-bit token ids; ``bucket`` is the
    exponent of the sequence's length. ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(id_col).alias("_pk_id"), F.col(text_col).alias("_pk_text"))
    schema = T.StructType([source.schema["_pk_id"], *SCHEMA.fields])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(vocabulary.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, stop in slices(batch.column(1), SLICE_BYTES):
                rows, starts, lengths, data, totals = [], [], [], [], []
                texts = ["" if t is None else t for t in batch.column(1).slice(begin, stop - begin).to_pylist()]
                for row, ids in enumerate(library.ids(texts), begin):
                    ids += end
                    at, n = 0, len(ids) // 4
                    for size in piece_lengths(n, longest):
                        rows.append(row)
                        starts.append(at)
                        lengths.append(size)
                        data.append(ids[4 * at : 4 * (at + size)])
                        totals.append(n)
                        at += size
                many = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(data, pa.binary()),
                        pa.array(totals, pa.int64()),
                        pa.array(np.arange(number, number + many)),
                        pa.array(np.zeros(many, np.int64)),
                        pa.array([n.bit_length() - 1 for n in lengths], pa.int32()),
                    ],
                    names=schema.names,
                )
                number += many

    return source.mapInArrow(run, schema).withColumnRenamed("_pk_id", id_col)


def with_checksum(ids: Column) -> Column:
    """CRC-32 of the little-endian ids, as an unsigned number."""
    return F.crc32(ids)
