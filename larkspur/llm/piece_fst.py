"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to the parts of one transducer:

* the *normaliser* writes a blank as U+2581 and puts one before the text;
* the *piece* transducer is a trie whose paths spell pieces and emit them, at
  the cost of minus their score;
* *byte fallback* reads a character that no piece spells and emits its bytes;
* the *order* acceptor: its state is the last piece, and a piece that cannot
  follow costs infinity. It is what turns a plain lattice into the encoding of
  a BPE model: a sequence of pieces is the encoding exactly when no merge
  reaches across the border of two neighbours. Its arcs are made when asked
  for and kept.

The composition with a text is searched for its shortest path in the tropical
semiring (min, +). As no piece has a U+2581 behind another character (checked
when compiling), the composition falls apart at words. A word falls apart again
between characters that no chain of pieces links, such as a letter and a full
stop: no piece spells both, and no merge reaches across, so the order costs
nothing there. The path of such a span is found once for each a worker meets.

Defined cases: null counts as empty and has no pieces; texts of any length are
encoded whole; an invalid byte sequence decodes to U+FFFD; repeated rows are
encoded alike; an empty table gives no rows; columns named like a result are
replaced and others kept. Models that are not BPE, or that carry a compiled
character map, are refused.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.text_arrays import slices

BLANK = "▁"
#: Spans, and arcs of the order acceptor, that one worker keeps, of each at most.
KEPT = 300_000
#: Ids that are decoded at a time.
SLICE_IDS = 1 << 17
#: Fixed values of the model file: field and type numbers of its messages.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE, MODEL_BPE = 1, 2, 3, 6, 2
#: What an unknown piece decodes to.
UNKNOWN_TEXT = " \u2047 "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Kept(dict):
    """Values made when first asked for; all are dropped when there are ``KEPT``."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.make(key)
        if len(self) >= KEPT:
            self.clear()
        self[key] = value
        return value


class PieceTransducer:
    """Compiled model: normaliser, pieces, byte fallback and order."""

    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        kinds: list[int] = []
        scores: list[float] = []
        self.prefix, self.squeeze, kind_of_model = True, True, 1
        for field, value in _fields(model):
            if field == PIECES:
                parts = dict(_fields(value))
                self.texts.append(parts[1].decode())
                scores.append(float(np.frombuffer(parts.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(parts.get(3, NORMAL))
            elif field == TRAINER:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif field == NORMALIZER:
                parts = dict(_fields(value))
                if parts.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                self.prefix, self.squeeze = bool(parts.get(3, 1)), bool(parts.get(4, 1))
        if kind_of_model != MODEL_BPE or self.squeeze:
            raise ValueError("only BPE models that keep white space are supported")
        if not set(kinds) <= {NORMAL, UNKNOWN, BYTE, CONTROL}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        if sum(k == BYTE for k in kinds) != 256:
            raise ValueError("models without a piece for every byte are not supported")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        if any(BLANK in t.lstrip(BLANK) for t in self.id):
            raise ValueError("a piece reaches over the end of a word")
        if any(c not in self.id for t in self.id for c in t):
            raise ValueError("a piece has a character that is no piece")
        self.cost = [-s for s in scores]
        self.byte = {int(self.texts[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = {i for i, k in enumerate(kinds) if k == UNKNOWN}
        # what every id spells; bytes are joined to characters apart
        self.spelled = [t.replace(BLANK, " ") if t in self.id else UNKNOWN_TEXT if i in self.unknown else "" for i, t in enumerate(self.texts)]
        self.is_byte = np.array([k == BYTE for k in kinds], bool)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.order = Kept(lambda arc: self._follows(*divmod(arc, len(self.texts))))
        self.spans = Kept(lambda span: array("i", self.path(span)).tobytes())

    @cached_property
    def trie(self) -> dict[str, list]:
        """The piece transducer: from a character to the next map and the piece spelled so far, or -1. Only encoding needs it."""
        root: dict[str, list] = {}
        for text, i in self.id.items():
            below = root
            for c in text:
                node = below.setdefault(c, [{}, -1])
                below = node[0]
            node[1] = i
        return root

    @cached_property
    def borders(self) -> re.Pattern:
        """Finds the spans of a normalised text: blanks, then characters that pieces link, directly or through others."""
        group: dict[str, set[str]] = {}
        for text in self.id:
            linked = set(text.lstrip(BLANK))
            for other in {id(group[c]): group[c] for c in linked if c in group}.values():
                linked |= other
            group |= dict.fromkeys(linked, linked)
        runs = ["".join(sorted(g)) for g in {id(g): g for g in group.values()}.values() if len(g) > 1]
        return re.compile(f"{BLANK}*(?:{''.join(f'[{re.escape(r)}]+|' for r in sorted(runs))}[^{BLANK}])|{BLANK}+")

    # --- normaliser
    def normalize(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    # --- order acceptor
    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that are merged last when the piece is built; None for one character."""
        if piece not in self.parts:
            symbols = [self.id.get(c, -1) for c in self.texts[piece]]
            last = None
            while len(symbols) > 1:
                joined = [self._joined(a, b) for a, b in zip(symbols, symbols[1:], strict=False)]
                at = min((k for k, j in enumerate(joined) if j >= 0), key=lambda k: (self.cost[joined[k]], k), default=-1)
                if at < 0:
                    last = None
                    break
                last = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = [joined[at]]
            self.parts[piece] = last
        return self.parts[piece]

    def _joined(self, a: int, b: int) -> int:
        return self.id.get(self.texts[a] + self.texts[b], -1) if a >= 0 and b >= 0 else -1

    def follows(self, a: int, b: int) -> float:
        """Cost of piece ``b`` behind ``a``: 0, or infinity where a merge would reach across."""
        return self.order[a * len(self.texts) + b]

    def _follows(self, a: int, b: int) -> float:
        limit, reached = math.inf, False  # merges cheaper than the limit (or as cheap, if reached) come first
        while True:
            joined = self._joined(a, b)
            if joined >= 0 and (self.cost[joined] < limit or (reached and self.cost[joined] == limit)):
                return math.inf
            of_a, of_b = self._halves(a), self._halves(b)
            if of_a is None and of_b is None:
                return 0.0
            if of_b is None or (of_a is not None and self.cost[a] > self.cost[b]):
                limit, reached, a = self.cost[a], False, of_a[1]
            else:
                limit, reached, b = self.cost[b], True, of_b[0]

    # --- shortest path
    def path(self, span: str) -> list[int]:
        """Pieces on the shortest path through the composition with a span of a normalised text.

        The order acceptor takes one sequence of pieces for every text, so a
        position of the span has at most one state of finite cost, which the
        position itself can stand for.
        """
        n, trie, costs, order, arc, pieces = len(span), self.trie, self.cost, self.order, self.order.get, len(self.texts)
        least, last, before, never = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1), math.inf
        least[0] = 0.0
        for at, c in enumerate(span):
            cost = least[at]
            if cost == never:
                continue
            node = trie.get(c)
            if node is None:  # no piece for this character: its bytes, after which anything can follow
                least[at + 1], before[at + 1] = cost, at
                continue
            a, end = last[at], at
            arcs = a * pieces
            while node is not None:
                below, piece = node
                end += 1
                if piece >= 0:
                    total = cost + costs[piece]
                    if total < least[end]:
                        if a >= 0:
                            weight = arc(arcs + piece)
                            total += order[arcs + piece] if weight is None else weight
                        if total < least[end]:
                            least[end], last[end], before[end] = total, piece, at
                node = below.get(span[end]) if end < n else None
        at, out = n, []
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.byte[b] for b in reversed(span[before[at] : at].encode())]
            at = before[at]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        return b"".join(map(self.spans.__getitem__, self.borders.findall(self.normalize(text))))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces spelled, bytes joined, blanks restored, the leading blank dropped."""
        spelled, listed = self.spelled, ids.tolist()
        if self.is_byte[ids].any():
            out, raw = [], bytearray()
            for i in listed:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(_lenient(bytes(raw)))
                    raw.clear()
                out.append(spelled[i])
            text = "".join([*out, _lenient(bytes(raw))])
        else:
            text = "".join([spelled[i] for i in listed])
        # the blank before the text was put there by the normaliser
        first = next((i for i in listed if spelled[i] or i in self.byte_of), None)
        dropped = self.prefix and first is not None and first not in self.byte_of and first not in self.unknown and text.startswith(" ")
        return text[1:] if dropped else text


def _lenient(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_made: dict[bytes, PieceTransducer] = {}


def _transducer(model: bytes) -> PieceTransducer:
    if model not in _made:
        _made.clear()
        _made[model] = PieceTransducer(model)
    return _made[model]


def _model(df: DataFrame, path: str):  # noqa: ANN202
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _encoded(transducer: PieceTransducer, texts: pa.Array) -> pa.ListArray:
    ids = [transducer.encode(t or "") for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _decoded(transducer: PieceTransducer, ids: pa.ListArray) -> pa.StringArray:
    return pa.array([None if row.values is None else transducer.decode(row.values.to_numpy()) for row in ids], pa.string())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with an array of piece ids and, if ``decoded`` names a column, the text that the ids decode to. No shuffle."""
    model = _model(docs, model_path)
    kept = [c for c in docs.columns if c not in (out, decoded)]
    made = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*(docs.schema[c] for c in kept), *made])
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model.value)
        for batch in batches:
            for begin, end in slices(batch.column(place)):
                part = batch.slice(begin, end - begin)
                ids = _encoded(transducer, part.column(place))
                back = [_decoded(transducer, ids)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *back], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids. No shuffle; null ids decode to null."""
    model = _model(encoded, model_path)
    kept = [c for c in encoded.columns if c != out]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(out, T.StringType())])
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model.value)
        for batch in batches:
            column = batch.column(place)
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(batch):  # some rows at a time, so their texts are not all held at once
                done = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_IDS, "right")))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(transducer, part.column(place))], names=schema.names)
                begin = end

    return encoded.select(*kept).mapInArrow(run, schema)


def round_trips(text: str, decoded: str):  # noqa: ANN201
    """Whether the decoded text is the text, in which U+2581 and a blank are the same."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(BLANK), F.lit(" ")) == F.col(decoded)
