import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat_format, media_chunks


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), 44 + len(payload)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_media_round_trip(table, request):
    docs = request.getfixturevalue(table)
    rows = media_chunks.load(*media_chunks.store(docs)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in rows), key=repr)
    assert got == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=repr)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_shared_chunks_are_stored_once(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    docs = spark.createDataFrame([(i, f"{i} head {body} tail {i}") for i in range(6)], "doc_id long, text string")
    lists, chunks = media_chunks.store(docs)
    assert chunks.count() == chunks.select("digest").distinct().count()
    total = lists.select(F.sum(F.size("digests"))).first()[0]
    assert chunks.count() < total / 4
    files = media_chunks.load(lists, chunks, with_file=True).collect()
    assert all(media_chunks.samples(bytes(r.file)).decode().rstrip() == f"{r.doc_id} head {body} tail {r.doc_id}" for r in files)


def test_a_damaged_chunk_is_found(spark):
    lists, chunks = media_chunks.store(spark.createDataFrame([(1, "same " * 900), (2, "same " * 900)], "doc_id long, text string"))
    other = spark.createDataFrame([(bytearray(media_chunks._pack(b"else")),)], "b binary")
    broken = chunks.crossJoin(other).select("digest", F.col("b").alias("bytes"))
    with pytest.raises(Exception, match="digest"):
        media_chunks.load(lists, broken).collect()


def test_chunks_follow_content():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    parts = media_chunks.split(data)
    assert b"".join(parts) == data and all(len(p) <= media_chunks.MOST for p in parts)
    moved = set(media_chunks.split(b"inserted" + data))
    assert len(moved & set(parts)) >= len(parts) - 3


def test_empty_media(empty):
    assert media_chunks.load(*media_chunks.store(empty)).collect() == []


TURNS = "conv_id long, turn long, role string, text string, position string"


def brute(rows):
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        text = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        out.append((c, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(4)
    words = ["hello", "</s>", "[INST]", "<", "\\", "[/INST]", "\\\\<\\", "日本", "😀", "a\nb", "<s>["]
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 2, 7, 150])):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 700]))), "p"))
    return [*rows, (50, 0, "user", None, "p"), (50, 1, "assistant", "", "p"), (51, 0, "assistant", "same", "p"), (51, 0, "assistant", "same", "p"), (52, None, None, "x", "p"), (None, 1, "assistant", "y", "p")]


def test_chat_digests_equal_brute_force(spark):
    rows = conversations()
    made = chat_format.windows(spark.createDataFrame(rows, TURNS))
    got = sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(made).collect()), key=repr)
    assert got == brute(rows)


def test_windows_keep_to_budget_history_and_system(spark):
    rows = conversations()
    rng = random.Random(9)
    for c in range(100, 140):  # system turns of any length, at any place, over and under the budget
        size, at = rng.choice([0, 1, 10, 94, 200, 250, 255, 256, 300]), rng.choice([0, 0, 3, None])
        for t in range(rng.choice([1, 5, 40])):
            wide = rng.choice([5, 5, 20, 60, 100, 160, 255, 256, 400])
            rows.append((c, t, ("user", "assistant")[t % 2], "u" * wide, "p"))
        rows.append((c, at, "system", "s" * size, "p"))
        if c % 3 == 0:
            rows.append((c, 4, "system", "later", "p"))
    made = chat_format.windows(spark.createDataFrame(rows, TURNS), budget=256, history=48, tokens=F.char_length("text").cast("long")).collect()
    assert len({(w.conv_id, w.window) for w in made}) == len(made)
    turns = {}
    for c, t, role, text, _ in rows:
        turns.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    seen = set()
    for w in made:
        whole = sorted(turns[w.conv_id])
        system = next((i for i, x in enumerate(whole) if x[1] == "system"), None)
        used = len(whole[system][2]) if system is not None else 0
        own = [s.position for s in w.segments if s.owned]
        assert own == list(range(own[0], own[0] + len(own)))
        assert seen.isdisjoint((w.conv_id, p) for p in own)
        seen.update((w.conv_id, p) for p in own)
        assert not any(s.target for s in w.segments if not s.owned or s.role != "assistant")
        assert system is None or [s.position for s in w.segments].count(system) == 1
        history = [s.position for s in w.segments if not s.owned and s.position != system]
        assert not history or history == list(range(own[0] - len(history), own[0]))
        assert sum(len(whole[p][2]) for p in history) <= 48
        assert w.n_tokens == sum(len(whole[s.position][2]) for s in w.segments)
        over = [p for p in own if p != system and len(whole[p][2]) + used > 256]
        assert w.n_tokens <= 256 or used > 256 or (over == own and not history), (w.n_tokens, used, own)
        for s in w.segments:
            body = w.formatted[s.begin : s.begin + s.length]
            assert not any(control in body for control in ("</s>", "[INST]", "[/INST]"))
            assert re.sub(r"([<\[\\])\\", r"\1", body) == whole[s.position][2]
    assert len(seen) == len(rows)


def test_one_conversation_windows_do_not_depend_on_others_or_formatted_chars(spark):
    rows = conversations()
    made = chat_format.windows(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r.formatted_chars for r in chat_format.digests(made).collect()}
    want = {}
    for w in made.collect():
        want[w.conv_id] = want.get(w.conv_id, 0) + len(w.formatted)
    assert got == want


def test_escape_is_reversible(spark):
    texts = ["", "\\", "<\\", "\\<", "[\\\\[", "</s>[INST] ok [/INST]", "$1 \\1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "</s>" not in r.e and "[INST]" not in r.e for r in rows)


def test_chat_plan_has_no_python(spark, data):
    from larkspur.llm.queries import queries

    plan = queries()["op7_chat_format"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_control_conversation_and_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.windows(none)).collect() == []
    (row,) = chat_format.digests(chat_format.windows(chat_format.with_control_strings(spark, none))).collect()
    text = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(text))
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
