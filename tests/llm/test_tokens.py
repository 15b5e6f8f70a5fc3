"""Token counts, packing and pieces against the tokenizers' own libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing, piece_fst, token_counts

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", " of", "'s", "'re", "'", "  ", "\n", "\r\n", "\t", "12", "½", "é", "日本", "😀", "!!", "-----", "<|endoftext|>", "<|end", "　", "\x85", "​", "▁", "x" * 40, "ing", "Ünder"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def transducer():
    with open(BPE, encoding="utf-8") as f:
        return token_counts.CountTransducer(token_counts.ByteMerges(f.read()))


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as f:
        return piece_fst.PieceTransducer(f.read())


def mixed(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(library, transducer):
    texts = mixed(3000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, transducer).tolist() == want


def test_chunked_counts_equal_whole_counts(library, transducer):
    for text in mixed(300, 4):
        want = len(library.encode(text, add_special_tokens=False).ids)
        for chunk in (1, 3, 8):
            assert token_counts.count_texts([text, ""], transducer, chunk).tolist() == [want, 0]


def test_state_maps_compose_associatively(transducer):
    text = " ".join(mixed(12, 5)).replace("<|endoftext|>", "")
    start = transducer.START
    for size in (6, 40):
        maps = lambda: token_counts.chunk_maps([text], transducer, size)[0]
        left = maps()[0]
        for m in maps()[1:]:
            left = left.then(m)
        right = maps()[-1]
        for m in reversed(maps()[:-1]):
            right = m.then(right)
        assert left.apply(start) == right.apply(start) == token_counts.combine(maps()).apply(start)


def test_a_text_without_a_boundary_takes_linear_time(library, transducer):
    """No pre-token ends in it; the states a chunk starts with are met again, so each chunk is run once or twice."""
    run, ran = type(transducer).run, []
    for n in (200_000, 3_000_000):
        for unit in ("x", "ab", "é", "aardvarkish"):
            text = (unit * n)[:n]
            ran.clear()
            transducer.run = lambda state, data: ran.append(len(data)) or run(transducer, state, data)
            got = token_counts.count_texts([text], transducer)[0]
            del transducer.run
            assert sum(ran) < 3 * len(text.encode()) + 100_000
            if n < 1_000_000:
                assert got == len(library.encode(text, add_special_tokens=False).ids)


def test_tables_are_begun_anew_inside_a_text(library):
    with open(BPE, encoding="utf-8") as f:
        small = token_counts.CountTransducer(token_counts.ByteMerges(f.read()), kept=50)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)), *mixed(50, 8)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, small, 100).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    global _cached
    try:
        library, counter, pieces, sp = _cached
    except NameError:
        with open(BPE, encoding="utf-8") as f:
            counter = token_counts.CountTransducer(token_counts.ByteMerges(f.read()))
        with open(MODEL, "rb") as f:
            pieces = piece_fst.PieceTransducer(f.read())
        library, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
        _cached = library, counter, pieces, sp
    assert token_counts.count_texts([text], counter)[0] == len(library.encode(text, add_special_tokens=False).ids)
    ids = np.frombuffer(pieces.encode(text), np.int32).tolist()
    assert ids == sp.encode(text)
    assert pieces.decode(np.array(ids, np.int32)) == text.replace("▁", " ")


def test_count_query_on_odd_rows(odd, empty, library):
    rows = token_counts.count_tokens(odd.drop("n_tokens"), BPE).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(empty, BPE).collect() == []


def test_packing_rebuilds_every_document(odd, empty, library):
    rows = packing.pack(odd, BPE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length == 1 << r.bucket <= 1024 and r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    texts = sorted(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in odd.collect())
    rebuilt, current = [], b""
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.start * 4 == len(current)
        current += bytes(r.ids)
        if len(current) == 4 * r.doc_tokens:
            rebuilt.append(current)
            current = b""
    assert current == b"" and sorted(rebuilt) == texts
    assert packing.pack(empty, BPE).collect() == []
    checked = packing.pack(odd, BPE).select("ids", packing.with_checksum(packing.F.col("ids")).alias("c")).first()
    assert checked.c == zlib.crc32(bytes(checked.ids))


def test_piece_lengths_are_binary_digits():
    assert packing.piece_lengths(2048 + 5) == [1024, 1024, 4, 1]
    for n in (1, 2, 1023, 1024, 5000):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 for p in parts)


def test_pieces_equal_the_library(pieces):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in [*mixed(2000, 6), " " * 40, "▁" * 33 + "a", "a" + " " * 17 + "b"]:
        ids = np.frombuffer(pieces.encode(text), np.int32).tolist()
        assert ids == sp.encode(text)
        assert pieces.decode(np.array(ids, np.int32)) == sp.decode(ids)
    for ids in ([0, 300], [3 + 0xE6, 3 + 0x97], [3 + 0x97, 500, 3 + 0xC3, 3 + 0xA9], [1, 2, 400]):
        assert pieces.decode(np.array(ids, np.int32)) == sp.decode(ids)


def test_null_ids_decode_to_null(spark):
    rows = piece_fst.decode(spark.createDataFrame([(1, [300, 400]), (2, None), (3, [])], "doc_id long, ids array<int>"), MODEL).collect()
    assert [(r.doc_id, r.decoded is None) for r in rows] == [(1, False), (2, True), (3, False)] and rows[2].decoded == ""


def test_piece_query_on_odd_rows(odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    both = piece_fst.decode(piece_fst.encode(odd, MODEL), MODEL)
    rows = both.withColumn("ok", piece_fst.round_trips("text", "decoded")).collect()
    assert all(r.ok and r.ids == sp.encode(r.text or "") for r in rows) and len(rows) == odd.count()
    at_once = piece_fst.encode(odd, MODEL, decoded="decoded").collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, both.collect()))
    assert piece_fst.encode(empty, MODEL).collect() == []


def all_paths(pieces, text):
    """Every accepted sequence of pieces for a text that pieces can spell."""
    found, open_ = [], [(0, ())]
    while open_:
        at, ids = open_.pop()
        if at == len(text):
            found.append(list(ids))
        for end in range(at + 1, len(text) + 1):
            i = pieces.id.get(text[at:end])
            if i is not None and (not ids or pieces.follows(ids[-1], i) == 0):
                open_.append((end, (*ids, i)))
    return found


def test_one_path_is_accepted_and_it_is_the_shortest(pieces):
    rng = random.Random(9)
    for text in ["".join(rng.choice("▁theandiorsTN.,!é0") for _ in range(rng.randint(1, 9))) for _ in range(400)]:
        assert all_paths(pieces, text) == [pieces.path(text)]


def test_paths_of_spans_join_to_the_path_of_the_text(pieces):
    for text in ("▁and,", "▁the.\nBy", "▁x!!日本é", "▁▁▁", "▁a▁▁b▁", "▁Об.the获取]-^"):
        spans = pieces.borders.findall(text)
        assert "".join(spans) == text
        assert [i for s in spans for i in pieces.path(s)] == pieces.path(text)
