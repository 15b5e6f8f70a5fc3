"""Language-model scores by Brown class-based bigrams.

P(text) is the product over its words of P(class | class before) times
P(word | class), closed by the end token, which is a class of its own. Classes
come from exchange clustering, as a sequence of Spark jobs:

* Texts are read one time, in blocks. A block numbers its distinct words and
  keeps its training texts, and its others, as one sequence of these numbers
  each, so a sweep does not unpack text by text.
* Every word has a class of its own. The table word -> class stays distributed
  in *parts* by the word's 64-bit hash, about ``PART_BYTES`` of text for each;
  a block gets the classes and counts of the words it holds, and no more. A
  second, independent hash tells words apart whose first hashes are equal.
* A *sweep* adds up, in every block, how often each class stands before and
  behind each word, and sums that by part. Then every part, in its own task,
  looks for the class of each word that raises the likelihood most, given the
  class bigrams of all. Sweeps move alternate halves of the words, so words
  that go together do not keep passing each other.
* A sweep that does not raise the likelihood is taken back. Sweeps end when
  neither half raises it by more than ``TOLERANCE``.
* Word counts are summed in the parts and come to the blocks with the classes.
  So no task and no broadcast holds the vocabulary, and a word that every block
  holds is one number in a packet of each block.

Smoothing: class bigrams are interpolated with class unigrams (weight
``PRIOR``), and P(word | class) = (c + 0.5) / (N_class + 0.5 (V_class + 1)),
where the 1 stands for unknown words; these are in the last word class.

Defined cases: null and empty texts have the end token alone; without training
texts all counts are 0 and scores are still finite; long texts are read whole;
repeated rows are scored, and learned from, each; an empty table gives no
rows; only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import count_blocks
from larkspur.llm.text_arrays import Words, slices, span_hashes, text_bytes
from larkspur.shared import discard, materialize

#: Classes with the end token's, the last.
CLASSES = 32
END = CLASSES - 1
#: Nats a token by which a sweep of either half must raise the likelihood for sweeps to go on.
TOLERANCE = 1e-3
#: Weight of class unigrams in P(class | class before), as a count.
PRIOR = 2.0
#: Bytes of text in a block, and for each part of the class table.
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Contexts that are weighed at once.
_CHUNK = 1 << 15


def _pack(values: np.ndarray, kind: str = "<i4") -> bytes:
    return pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(pa.input_stream(pa.py_buffer(packed), compression="zstd").read(), kind)


def _join(packed: list[bytes], kind: str = "<i4") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unpack(p, kind) for p in packed)])


#: Parts of rows that hold the sequence of a block's training texts, and of its others.
TRAINED, HELD = -1, -2


def _sequence(lids: np.ndarray, doc: np.ndarray, chosen: np.ndarray) -> bytes:
    """The words of the chosen texts as numbers from 1, each text closed by a 0."""
    words = chosen[doc]
    text = np.cumsum(chosen)[doc[words]] - 1
    out = np.zeros(len(text) + int(chosen.sum()), "<i4")
    out[np.arange(len(text)) + text] = lids[words] + 1
    return _pack(out)


def _closed(table: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a sequence, the places of its words, and the words."""
    at = np.flatnonzero(sequence)
    return np.concatenate([np.array([END], np.uint8), table])[sequence], at, sequence[at] - 1


_NUMBERED = "part int, block long, numbers binary, lids binary"


def _numbered(first: np.ndarray, second: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different pairs of hashes there are, and the number of each."""
    known, at, number = np.unique(first, return_index=True, return_inverse=True)
    if (second == second[at][number]).all():
        return len(known), number
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return int(new.sum()), number


def number_words(packets: DataFrame) -> DataFrame:
    """Numbers of words in their part, for each block that holds them.

    Two more rows for each part: block -1 with the training counts of all its
    words, and block -2 with the most frequent ones and their counts.
    """

    def run(table: pa.Table) -> pa.Table:
        hashes = [_unpack(d, "<u8").reshape(2, -1) for d in table["data"].to_pylist()]
        halves = [_unpack(n).reshape(2, -1) for n in table["numbers"].to_pylist()]
        known, number = _numbered(*np.concatenate(hashes, axis=1))
        counts = np.bincount(number, np.concatenate([h[1] for h in halves]), known).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[: END - 1]
        cuts = np.cumsum([h.shape[1] for h in hashes])[:-1]
        part = table["part"][0].as_py()
        return pa.table(
            {
                "part": pa.array([part] * (len(hashes) + 2), pa.int32()),
                "block": pa.array([*table["block"].to_pylist(), -1, -2], pa.int64()),
                "numbers": pa.array([*map(_pack, np.split(number, cuts)), _pack(counts, "<i8"), _pack(top)], pa.binary()),
                "lids": pa.array([*(_pack(h[0]) for h in halves), None, _pack(counts[top], "<i8")], pa.binary()),
            }
        )

    return materialize(packets.groupBy("part").applyInArrow(run, _NUMBERED), "word-numbers")


def first_classes(numbered: DataFrame) -> DataFrame:
    """The most frequent words as the only members of their classes, all others in the last word class."""
    found = []
    for row in numbered.where("block = -2").toLocalIterator():  # END - 1 words of each part
        counts = _unpack(bytes(row["lids"]), "<i8").tolist()
        found += [(-c, row["part"], i) for c, i in zip(counts, _unpack(bytes(row["numbers"])).tolist(), strict=True) if c]
    alone: dict[int, list[tuple[int, int]]] = {}
    for c, (_, part, i) in enumerate(sorted(found)[: END - 1]):
        alone.setdefault(part, []).append((i, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                classes = np.full(len(_unpack(counts, "<i8")), END - 1, np.uint8)
                for i, c in alone.get(part, []):
                    classes[i] = c
                packed.append(_pack(classes, "u1"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["part", "classes"])

    return materialize(numbered.where("block = -1").select("part", "numbers").mapInArrow(run, "part int, classes binary"), "classes")


def labelled(numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """The numbered words of each block with their classes."""

    def run(words: pa.Table, table: pa.Table) -> pa.Table:
        own = _unpack(table["classes"][0].as_py(), "u1")
        return words.append_column("classes", pa.array([_pack(own[_unpack(n)], "u1") for n in words["numbers"].to_pylist()], pa.binary()))

    packets = numbered.where("block >= 0")
    return packets.groupBy("part").cogroup(classes.groupBy("part")).applyInArrow(run, _NUMBERED + ", classes binary")


def counted(numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """The words of each block: ``block, part``, their numbers in the block, classes and training counts."""

    def run(words: pa.Table, table: pa.Table) -> pa.Table:
        own, counts = _unpack(table["classes"][0].as_py(), "u1"), _unpack(table["counts"][0].as_py(), "<i8")
        numbers = [_unpack(n) for n in words["numbers"].to_pylist()]
        columns = {
            "block": words["block"],
            "part": words["part"],
            "numbers": words["lids"],
            "data": pa.array([_pack(own[n], "u1") for n in numbers], pa.binary()),
            "counts": pa.array([_pack(counts[n], "<i8") for n in numbers], pa.binary()),
        }
        return pa.table(columns)

    table = classes.join(numbered.where("block = -1").select("part", F.col("numbers").alias("counts")), "part")
    packets = numbered.where("block >= 0")
    return packets.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(run, "block long, part int, numbers binary, data binary, counts binary")


def context_counts(texts: DataFrame, words: DataFrame, half: int) -> DataFrame:
    """Contexts of one half of the words by part and block, and in part -1 the class bigrams of the block.

    A context's key is its word's number times 64, the class before, or the
    class behind plus 32.
    """

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        lids = _join(words["lids"].to_pylist())
        numbers = [_unpack(n).astype(np.int64) for n in words["numbers"].to_pylist()]
        table, place, mine = np.zeros(len(lids), np.uint8), np.zeros(len(lids), np.int64), np.zeros(len(lids), bool)
        table[lids] = _join(words["classes"].to_pylist(), "u1")
        place[lids] = np.arange(len(lids))
        mine[lids] = np.concatenate([np.zeros(0, np.int64), *numbers]) % 2 == half
        tokens, at, seen = _closed(table, _join(texts["data"].to_pylist()))
        previous = np.concatenate([np.full(min(len(tokens), 1), END, np.uint8), tokens[:-1]])
        pairs = np.bincount(previous.astype(np.int16) * CLASSES + tokens, minlength=CLASSES * CLASSES)
        chosen = mine[seen]
        where, at = (place * 64)[seen[chosen]], at[chosen]
        both = np.concatenate([where + previous[at], where + (tokens[at + 1] + np.uint8(32))])
        # small keys sort faster
        keys, counts = np.unique(both.astype(np.int32) if len(lids) < 1 << 25 else both, return_counts=True)
        keys = keys.astype(np.int64)
        out, base = [(-1, None, _pack(pairs, "<i8"))], 0
        for part, number in zip(words["part"].to_pylist(), numbers, strict=True):
            a, b = np.searchsorted(keys, [base * 64, (base + len(number)) * 64])
            if b > a:
                own = number[(keys[a:b] >> 6) - base] * 64 + (keys[a:b] & 63)
                out.append((part, _pack(np.diff(own, prepend=0), "<i8"), _pack(counts[a:b])))
            base += len(number)
        columns = zip(*out, strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "counts"])

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "part int, keys binary, counts binary")


def _pairs(contexts: DataFrame) -> np.ndarray:
    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpack(p, "<i8") for p in table["counts"].to_pylist())
        return pa.table({"counts": pa.array([_pack(total, "<i8")], pa.binary())})

    salted = contexts.where("part = -1").withColumn("salt", F.floor(F.rand(1) * 32))
    rows = salted.groupBy("salt").applyInArrow(add, "counts binary").collect()
    return sum((_unpack(bytes(r["counts"]), "<i8") for r in rows), np.zeros(CLASSES * CLASSES, np.int64)).reshape(CLASSES, CLASSES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Nats a token that class bigrams add to word unigrams."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum()) / max(int(pairs.sum()), 1)


def _more(there: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By how much x log x rises where ``count`` is added to ``there``."""
    there = np.maximum(there, 0)
    return _xlogx(there + count) - _xlogx(there)


def _gains(word: np.ndarray, behind: np.ndarray, other: np.ndarray, count: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Gain of each word in each word class, from its contexts, ordered by word.

    What a context gains in a class depends on nothing but the class beside it,
    the side and the count, so it is worked out one time for each of these; in
    the word's present class its own count is taken off first.
    """
    n = np.bincount(word, np.where(behind, 0, count), len(own)).astype(np.int64)
    kinds, first, of = np.unique((count * 2 + behind) * CLASSES + other, return_index=True, return_inverse=True)
    beside, after, often = other[first], behind[first][:, None], count[first][:, None]
    each = _more(np.where(after, pairs[:END, :].T[beside], pairs[:, :END][beside]), often)[of]
    mine = own[word]
    each[np.arange(len(word)), mine] = _more(np.where(behind, pairs[mine, other], pairs[other, mine]) - count, count)
    gain = np.zeros((len(own), END))
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    if len(begins):
        gain[word[begins]] = np.add.reduceat(each, begins, axis=0)
    sizes, of = np.unique(n, return_inverse=True)
    for margin in (pairs.sum(axis=1), pairs.sum(axis=0)):
        loss = _more(margin[None, :END], sizes[:, None])[of]
        loss[np.arange(len(own)), own] = _more(margin[own] - n, n)
        gain -= loss
    return gain


def best_classes(before: np.ndarray, behind: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each word the word class that gains most likelihood from holding it.

    ``before`` and ``behind`` are words x classes; the word's own counts are
    taken off its present class first. Words that never occur stay.
    """
    both = np.concatenate([before, behind], axis=1)
    word, other = np.nonzero(both)
    gain = _gains(word, other >= CLASSES, other % CLASSES, both[word, other], own, pairs)
    return np.where(before.sum(axis=1) > 0, gain.argmax(axis=1), own)


def exchange(contexts: DataFrame, classes: DataFrame, pairs: np.ndarray) -> DataFrame:
    """New classes of the words that have contexts here, found part by part in tasks."""

    def run(found: pa.Table, table: pa.Table) -> pa.Table:
        own = _unpack(table["classes"][0].as_py(), "u1").astype(np.int64)
        keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpack(k, "<i8")) for k in found["keys"].to_pylist())])
        counts = _join(found["counts"].to_pylist()).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        if len(first):
            keys, counts = keys[first], np.add.reduceat(counts, first)
        word, made, a = keys >> 6, own.copy(), 0
        while a < len(keys):
            b = int(np.searchsorted(word, word[min(a + _CHUNK, len(keys)) - 1], "right"))  # whole words
            some, number = np.unique(word[a:b], return_inverse=True)
            gain = _gains(number, (keys[a:b] & 32) > 0, keys[a:b] & 31, counts[a:b], own[some], pairs)
            made[some] = gain.argmax(axis=1)
            a = b
        return pa.table({"part": table["part"].slice(0, 1), "classes": pa.array([_pack(made, "u1")], pa.binary())})

    moved = contexts.where("part >= 0").groupBy("part").cogroup(classes.groupBy("part"))
    return materialize(moved.applyInArrow(run, "part int, classes binary"), "classes")


def cluster(texts: DataFrame, numbered: DataFrame, sweeps: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Classes of all words by part, and the class bigrams under them; at most ``sweeps`` sweeps, where given."""

    def measured(classes: DataFrame, half: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
        contexts = materialize(context_counts(texts, labelled(numbered, classes), half), "contexts")
        return classes, contexts, _pairs(contexts)

    now = measured(first_classes(numbered), 0)
    done = idle = 0
    while idle < 2 and (sweeps is None or done < sweeps):
        tried = measured(exchange(now[1], now[0], now[2]), (done + 1) % 2)
        rise = likelihood(tried[2]) - likelihood(now[2])
        done, idle = done + 1, 0 if rise > TOLERANCE else idle + 1
        if rise > 0:
            discard(*now[:2])
            now = tried
        else:  # the classes stay; the other half's contexts are under them
            discard(*tried[:2], now[1])
            now = measured(now[0], done % 2)
    discard(now[1])
    return now[0], now[2]


@dataclass(frozen=True)
class ClassBigrams:
    """log10 P(class | class before), from counts and the prior on class unigrams."""

    log10: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, prior: float = PRIOR) -> ClassBigrams:
        unigram = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
        return cls(np.log10((pairs + prior * unigram) / (pairs.sum(axis=1, keepdims=True) + prior)))


def class_totals(numbered: DataFrame, classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each class in the training texts."""

    def run(counts: pa.Table, table: pa.Table) -> pa.Table:
        c, own = _unpack(counts["numbers"][0].as_py(), "<i8"), _unpack(table["classes"][0].as_py(), "u1")
        n, v = np.bincount(own, c, CLASSES).astype(np.int64), np.bincount(own[c > 0], minlength=CLASSES)
        return pa.table({"class": pa.array(np.arange(CLASSES)), "n": pa.array(n), "v": pa.array(v)})

    each = numbered.where("block = -1").groupBy("part").cogroup(classes.groupBy("part")).applyInArrow(run, "class long, n long, v long")
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in each.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    return n, v


#: Rows of the reading pass: of a document (part is null) with its place in a sequence, of a sequence, or of a block's words in a part.
_ENCODED = "block long, part int, doc_id {id}, held_out boolean, place int, data binary, numbers binary"


def _encode(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as sequences of block-numbered words, and the words of each block with their training counts."""
    schema = T.StructType.fromDDL(_ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString()))
    arrow = [pa.int64(), pa.int32(), None, pa.bool_(), pa.int32(), pa.binary(), pa.binary()]

    def rows(n: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        kinds = [k or id_type for k in arrow]
        return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(n, k)) for f, k in zip(schema.names, kinds, strict=True)], names=schema.names)

    def block_rows(block: int, ids: pa.Array, held: np.ndarray, column: pa.Array) -> Iterator[pa.RecordBatch]:
        hashes, data, starts, sizes, counts, base = [], [], [], [], [], 0
        for begin, end in slices(column):
            words = Words(*text_bytes(column.slice(begin, end - begin)))
            hashes.append(words.hash)
            starts.append(words.start + base)
            sizes.append(words.end - words.start)
            counts.append(words.counts)
            data.append(words.data)
            base += len(words.data)
        count, joined = np.concatenate(counts), np.concatenate(data)
        start, hashed = np.concatenate(starts), np.concatenate(hashes)
        second = span_hashes(joined, start, start + np.concatenate(sizes), other=True)
        doc = np.repeat(np.arange(len(count)), count)
        different, number = _numbered(hashed, second)
        often = np.bincount(number, minlength=different)
        rank = np.empty(different, np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(different)  # frequent words get small numbers
        lid = rank[number]
        first = np.empty(different, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        known, check = hashed[first], second[first]
        trained = np.bincount(lid[~held[doc]], minlength=different)
        home = ((known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # in the order of hashes
        own, cut = np.unique(home, return_index=True)
        packets = [((known[a:b], check[a:b]), (rank[a:b], trained[rank[a:b]])) for a, b in zip(cut, [*cut[1:], different], strict=True)]
        yield rows(
            len(own),
            ids.type,
            block=pa.array(np.full(len(own), block)),
            part=pa.array(own, pa.int32()),
            data=pa.array([_pack(np.concatenate(h), "<u8") for h, _ in packets], pa.binary()),
            numbers=pa.array([_pack(np.concatenate(n)) for _, n in packets], pa.binary()),
        )
        yield rows(
            2,
            ids.type,
            block=pa.array([block, block]),
            part=pa.array([TRAINED, HELD], pa.int32()),
            data=pa.array([_sequence(lid, doc, ~held), _sequence(lid, doc, held)], pa.binary()),
        )
        yield rows(
            len(count),
            ids.type,
            block=pa.array(np.full(len(count), block)),
            doc_id=ids,
            held_out=pa.array(held),
            place=pa.array(np.where(held, np.cumsum(held), np.cumsum(~held)) - 1, pa.int32()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gathered, size = TaskContext.get().partitionId() << 24, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(gathered).combine_chunks()
            ids, held, column = (table.column(i).combine_chunks() for i in range(3))
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            yield from block_rows(block, ids, np.array(held.to_pylist(), bool), column)

        for batch in batches:
            for begin, end in slices(batch.column(2)):
                part = batch.slice(begin, end - begin)
                gathered.append(part)
                size += int(text_bytes(part.column(2))[1][-1])
                if size >= BLOCK_BYTES:
                    yield from close()
                    block, gathered, size = block + 1, [], 0
        if gathered:
            yield from close()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def score(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", sweeps: int | None = None) -> DataFrame:
    """Scores of all documents under the model of those whose fold is not held out.

    ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``
    (log10; ``base_score`` is that of add-half unigrams), ``perplexity``.
    """
    split = docs.select(F.col(id_col).alias("doc_id"), (count_blocks.bucket(id_col, folds) == fold).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = split.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    encoded = materialize(_encode(split, 1 + size // PART_BYTES), "encoded")
    numbered = number_words(encoded.where("part >= 0").select("part", "block", "data", "numbers"))
    read = encoded.where("part is null or part < 0")
    classes, pairs = cluster(read.where(f"part = {TRAINED}").select("block", "data"), numbered, sweeps)
    n_class, v_class = class_totals(numbered, classes)
    ends = int(pairs[:, END].sum())
    n_all, v_all = int(n_class.sum()) + ends, int(v_class.sum()) + (ends > 0)
    below_class = np.log10(n_class + 0.5 * (v_class + 1))
    below_class[END] = 0.0  # the end class has one member
    below_base, of_end = float(np.log10(n_all + 0.5 * (v_all + 1))), float(np.log10(ends + 0.5))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
            *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity")),
        ]
    )

    log10 = ClassBigrams.of(pairs).log10

    def run(texts: pa.Table, packets: pa.Table) -> pa.Table:
        lids = _join(packets["numbers"].to_pylist())
        c, table = np.zeros(len(lids), np.int64), np.zeros(len(lids), np.uint8)
        c[lids] = _join(packets["counts"].to_pylist(), "<i8")
        table[lids] = _join(packets["data"].to_pylist(), "u1")
        value, known = np.log10(c + 0.5), c > 0
        sequences = texts.filter(pc.is_valid(texts["part"]))
        stored = dict(zip(sequences["part"].to_pylist(), sequences["data"].to_pylist(), strict=True))
        sums = [np.zeros((0, 4))]
        for part in (TRAINED, HELD):
            sequence = _unpack(stored[part])
            tokens, at, seen = _closed(table, sequence)
            closes = np.flatnonzero(sequence == 0)
            begins = np.concatenate([[0], closes + 1])[: len(closes)]
            each = np.zeros((len(sequence), 3))
            each[at, 0], each[at, 1] = value[seen], known[seen]
            each[:, 2] = log10[np.concatenate([np.full(min(len(tokens), 1), END, np.uint8), tokens[:-1]]), tokens] - below_class[tokens]
            sums.append(np.column_stack([np.add.reduceat(each, begins, axis=0), closes + 1 - begins]) if len(closes) else np.zeros((0, 4)))
        texts = texts.filter(pc.is_null(texts["part"]))
        held = np.array(texts["held_out"].to_pylist(), bool)
        total, hits, between, n = np.concatenate(sums)[texts["place"].to_numpy() + held * len(sums[1])].T
        hits, n = hits.astype(np.int64), n.astype(np.int64)
        model = total + between
        columns = [
            texts["doc_id"].combine_chunks(),
            texts["held_out"].combine_chunks(),
            pa.array(n),
            pa.array(hits + (ends > 0)),
            pa.array(np.full(len(texts), n_all)),
            pa.array(total + of_end - n * below_base),
            pa.array(model),
            pa.array(10 ** (-model / n)),
        ]
        return pa.table(columns, names=schema.names)

    texts = read.select("block", "part", "doc_id", "held_out", "place", "data")
    return texts.groupBy("block").cogroup(counted(numbered, classes).groupBy("block")).applyInArrow(run, schema)
