"""Token counts by a compiled finite-state transducer.

The vocabulary of a byte-level BPE file is compiled to a deterministic
transducer over bytes. Its transitions are annotated with the change of the
emitted-token count, so running a pre-token through it and adding up the
annotations gives the number of tokens without building them.

Why it is finite-state: an encoding is the one sequence of tokens in which
every two neighbours are *compatible* (merging their joint bytes leaves
exactly these two). So the encoding of a prefix is found from the last tokens
of earlier prefixes, and only those from which a vocabulary entry can still be
running matter. A state holds, for each such place, the node in the vocabulary
trie, the last token before it and its count relative to now. States and
transitions are made when first met and kept up to a bound, then begun anew.

All texts are cut into chunks. A chunk's *state map* takes an entry state to an
exit state and a count. What lies before the first pre-token boundary of the
chunk has to be run from the entry state; all behind that is fixed. Maps are
tables over the entry states that occur: a chunk without a boundary starts with
the state that running its last few hundred bytes before it suggests, and runs
again only for an entry state that is not in its table. Maps compose
associatively: :func:`combine` merges neighbours pair by pair, the up-sweep of
a prefix scan, and keeps the total alone. No bytes are copied, so time and
memory are linear even in a text that is one pre-token.

Defined cases: null counts as empty; empty texts have 0 tokens; texts of any
length are counted whole; repeated rows are counted alike; an empty table
gives no rows; extra columns with any names are kept or dropped by the caller.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.pretokens import boundaries, code_points
from larkspur.llm.text_arrays import slices

#: Transitions, and counts of pre-tokens, that one Python worker keeps at most.
KEPT = 700_000
#: Code points of a chunk of a long text.
CHUNK = 1 << 16
#: Characters on each side of a position that decide whether a pre-token starts there.
MARGIN = 4
#: Code points before a chunk without a boundary that suggest its entry state.
WARM = 512
#: Code points of the longest pre-token whose count is kept.
LONGEST_KEPT = 100


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteMerges:
    """Tokens, merges and the compatibility of neighbours of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary_json: str) -> None:
        model = json.loads(vocabulary_json)
        byte = byte_symbols()
        vocab = model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.special = next(iter(special), "")
        self.tokens = {bytes(byte[c] for c in name): i for name, i in vocab.items() if name not in special}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = rank
            if made not in self.rank:
                self.rank[made], self.parts[made] = rank, (a, b)

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge reaches across the border of neighbours ``a`` and ``b``.

        Undoes the merges inside both from the last to the first and looks
        whether the two symbols at the border would have merged earlier.
        """
        limit = 1 << 60
        while True:
            rank = self.pair.get((a, b))
            if rank is not None and rank < limit:
                return False
            of_a, of_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                limit, a = of_a, self.parts[a][1]
            else:
                limit, b = of_b + 1, self.parts[b][0]


class CountTransducer:
    """Deterministic transducer over bytes whose transitions carry token counts."""

    START: tuple = ((0, None, 0),)

    def __init__(self, merges: ByteMerges, kept: int = KEPT) -> None:
        self.merges, self.kept = merges, kept
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for name, i in merges.tokens.items():
            node = 0
            for b in name:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][b]
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        # a state: places from which an entry can still run, as (trie node, token before it, count there minus count now)
        self.states: list[tuple] = [self.START]
        self.number = {self.START: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.words: dict[str, int] = {}

    def _fit(self, before: int | None, token: int) -> bool:
        if before is None:
            return True
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) >= self.kept:
                self.fits.clear()
            known = self.fits[before, token] = self.merges.compatible(before, token)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        running, last, delta = [], None, 0
        for node, before, count in self.states[state]:
            then = self.child[node].get(byte)
            if then is None:
                continue
            running.append((then, before, count))
            token = self.token[then]
            if token is not None and last is None and self._fit(before, token):
                last, delta = token, count + 1
        made = tuple((n, t, c - delta) for n, t, c in running if self.child[n]) + ((0, last, 0),)
        number = self.number.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        self.moves[state << 8 | byte] = number, delta
        return number, delta

    def run(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """The state after ``data`` and the change of the token count."""
        if len(self.moves) > self.kept or len(self.words) > self.kept:
            self.clear()  # states are told apart by what they hold, so nobody keeps their numbers
        total, moves = 0, self.moves
        now = self.number.setdefault(state, len(self.states))
        if now == len(self.states):
            self.states.append(state)
        for byte in data:
            found = moves.get(now << 8 | byte)
            now, delta = found if found is not None else self._move(now, byte)
            total += delta
        return self.states[now], total

    def count(self, piece: str) -> int:
        """Tokens of one whole pre-token."""
        known = self.words.get(piece)
        if known is None:
            known = self.run(self.START, piece.encode("utf-8", "surrogatepass"))[1]
            if len(piece) <= LONGEST_KEPT:
                self.words[piece] = known
        return known


class StateMap:
    """What a stretch of text does to an entry state: a table from entry states to exit state and count.

    Of a chunk: ``head`` is run from the entry state, ``fixed`` (exit state and
    count) is what follows behind the chunk's first boundary, None where it has none.
    """

    def __init__(self, of: CountTransducer, head: str = "", fixed: tuple[tuple, int] | None = None, parts: tuple[StateMap, StateMap] | None = None) -> None:
        self.of, self.head, self.fixed, self.parts = of, head, fixed, parts
        self.table: dict[tuple, tuple[tuple, int]] = {}

    def apply(self, state: tuple) -> tuple[tuple, int]:
        known = self.table.get(state)
        if known is None:
            if self.parts:
                middle, before = self.parts[0].apply(state)
                after, behind = self.parts[1].apply(middle)
                known = after, before + behind
            else:
                after, count = self.of.run(state, self.head.encode("utf-8", "surrogatepass"))
                known = (after, count) if self.fixed is None else (self.fixed[0], count + self.fixed[1])
            self.table[state] = known
        return known

    def then(self, other: StateMap) -> StateMap:
        """Both, one after the other, for the entry states that this map has in its table."""
        both = StateMap(self.of, parts=(self, other))
        for state in self.table:
            both.apply(state)
        return both


def combine(maps: list[StateMap]) -> StateMap:
    """The composition of all maps, in rounds that merge neighbours; all merges of a round are independent."""
    while len(maps) > 1:
        merged = [a.then(b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = merged + maps[2 * len(merged) :]
    return maps[0]


def _windows(texts: list[str], chunk: int) -> Iterator[list[tuple[int, str, int, int, int]]]:
    """Groups of chunks: number of the text, the text, begin and end of the chunk, and begin of a window around it."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), chunk):
            end, low = min(at + chunk, len(text)), max(0, at - MARGIN)
            group.append((i, text, at, end, low))
            size += end - low
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def chunk_maps(texts: list[str], transducer: CountTransducer, chunk: int) -> list[list[StateMap]]:
    """The state maps of the chunks of each text; texts hold no special strings."""
    out: list[list[StateMap]] = [[] for _ in texts]
    for group in _windows(texts, chunk):
        windows = [text[low : end + MARGIN] for _, text, _, end, low in group]
        buffer, sizes = "".join(windows), np.fromiter(map(len, windows), np.int64, len(windows))
        base = np.cumsum(sizes) - sizes
        low, at, end = (np.array([g[k] for g in group], np.int64) for k in (4, 2, 3))
        begins, ends = base + at - low, base + end - low
        found = boundaries(code_points(buffer), base)
        # a window's own start lies before its chunk, unless the text starts there
        first, last = np.searchsorted(found, begins), np.searchsorted(found, ends)
        closed = np.array([len(text) == stop for _, text, _, stop, _ in group])
        cuts = found.tolist()
        for k, (i, text, start, stop, _) in enumerate(group):
            a, b = int(first[k]), int(last[k])
            if a == b:
                made = StateMap(transducer, text[start:stop])
                made.apply(transducer.run(transducer.START, text[max(0, start - WARM) : start].encode("utf-8", "surrogatepass"))[0])
                out[i].append(made)
                continue
            borders = [*cuts[a:b], int(ends[k])]
            pieces = [buffer[x:y] for x, y in zip(borders, borders[1:], strict=False)]
            state, tail = transducer.START, 0
            if not closed[k]:
                state, tail = transducer.run(state, pieces.pop().encode("utf-8", "surrogatepass"))
            known = transducer.words
            total = sum([known[p] if p in known else transducer.count(p) for p in pieces])
            out[i].append(StateMap(transducer, buffer[int(begins[k]) : borders[0]], (state, total + tail)))
    return out


_made: dict[str, CountTransducer] = {}


def _transducer(vocabulary_json: str) -> CountTransducer:
    """One transducer a worker and vocabulary."""
    if vocabulary_json not in _made:
        _made.clear()
        _made[vocabulary_json] = CountTransducer(ByteMerges(vocabulary_json))
    return _made[vocabulary_json]


def count_texts(texts: list[str], transducer: CountTransducer, chunk: int = CHUNK) -> np.ndarray:
    """Token counts of texts of any length, by composing the maps of their chunks."""
    special = transducer.merges.special
    stretches, owner, out = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.split(special) if special and special in text else [text]
        out[i] = len(parts) - 1
        for part in filter(None, parts):
            stretches.append(part)
            owner.append(i)
    counts = [combine(maps).apply(transducer.START)[1] for maps in chunk_maps(stretches, transducer, chunk)]
    np.add.at(out, owner, counts)
    return out


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    The vocabulary file is read once, on the driver (its size does not depend
    on the data). No shuffle: counts are made where the rows are read.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    rest = docs.select(*names, F.coalesce(text_col, F.lit("")).alias("_tc_text"))
    made = rest.select(*names, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(vocabulary.value)
        for batch in batches:
            column = batch.column(len(names))
            counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for begin, end in slices(column):
                texts = column.slice(begin, end - begin)
                counts.append(count_texts(texts.to_pylist(), transducer))
                sizes.append(np.array(pa.compute.binary_length(texts), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts))], names=[*names, "n_bytes", "n_tokens"])

    return rest.mapInArrow(run, made.schema).withColumn("over_limit", F.col("n_tokens") > limit)
