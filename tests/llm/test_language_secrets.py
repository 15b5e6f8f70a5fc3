import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import language_id, secrets
from larkspur.llm.queries import queries


def test_held_out_accuracy(spark, data, documents):
    rows = queries()["op9_language_id"](spark, data).join(documents.select("doc_id", "text", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_identify_odd_rows(odd, empty):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 8, 9}
    assert got[6].lang_pred == "en" and got[2].score == 0
    assert language_id.identify(empty).collect() == []
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 8, 9})


def test_nothing_learned_is_und(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs).collect()] == [("und", 0.0)]


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    spans = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_equal_brute_force(spark, data, documents):
    got = {r.doc_id: r for r in queries()["op5_secrets"](spark, data).collect()}
    for r in documents.collect():
        want = brute(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert set(text.split(",")) <= set(got[r.doc_id].spans.split(",")) | {""}
    tricky = ["token: key = abcdefgh", "paſſword=abcdef apiKey='x_1.2=-'", "token=ab token=abcdef", "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 12, "0" * 23 + "g" + "a" * 24]
    for t in tricky:
        assert secrets.base_spans(t) == brute(t)


RANDOM = "aB3" * 13 + "x"
WEAK = [
    (1, f"user=alice01 then {RANDOM} end"),
    (2, f"{RANDOM} alone"),
    (3, "user=alice01 alone"),
    (4, f"user=alice01\n\n{RANDOM}"),
    (5, f"user=alice01 {'.' * 500} {RANDOM}"),
    (6, "see https://db.example.org/x and password=hunter22"),
    (7, "see https://example.org/x only"),
    (8, None),
    (9, " ".join(f"user=u{i:04d} {RANDOM}" for i in range(300))),
    (10, f"token={'j' * 600}\nhttps://db.example.org/x"),
    (11, f"https://files.example.org/{'p' * 900} {'.' * 390} {RANDOM} {'.' * 500} user=bobby"),
]


def near(text):
    """Every weak span against every other part: the quadratic definition."""
    spans = secrets.scan(text)
    keep = []
    for s in spans:
        others = [o for o in spans if o["scope"] == s["scope"] and secrets.ROLE[o["kind"]] != secrets.ROLE[s["kind"]] and max(o["start"] - s["end"], s["start"] - o["end"]) <= secrets.REACH]
        if s["kind"] in secrets.STRONG or others:
            keep.append((s["kind"], s["start"], s["end"]))
    return keep


def test_weak_parts_need_a_complement(spark):
    docs = spark.createDataFrame(WEAK, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_spans(docs).collect()}
    assert got == {i: near(t or "") for i, t in WEAK}
    assert [k for k, _, _ in got[1]] == ["account", "random"] and got[2] == got[3] == got[4] == got[5] == got[7] == []
    assert [k for k, _, _ in got[6]] == ["endpoint", "assign"] and len(got[9]) == 600


def test_linking_equals_the_quadratic_definition(spark):
    """Spans of all lengths at all distances, several scopes and documents, with a small reach."""
    rng, rows, want = random.Random(11), [], set()
    for key in "abcdef":
        own = []
        for _ in range(60):
            start = rng.randrange(900)
            own.append((key, rng.randrange(2), rng.choice(secrets.KINDS), start, start + rng.choice([1, 3, 8, 20, 130])))
        rows += own
        for k, scope, kind, a, b in own:
            near_by = any(o[1] == scope and secrets.ROLE[o[2]] != secrets.ROLE[kind] and max(o[3] - b, a - o[4]) <= 8 for o in own)
            if kind not in secrets.STRONG and near_by:
                want.add((k, scope, kind, a, b))
    spans = spark.createDataFrame(rows, "_se_key string, scope int, kind string, start int, end int")
    assert sorted(tuple(r) for r in secrets.linked(spans, 8).collect()) == sorted(want)


def test_ids_that_hold_colons_keep_documents_apart(spark):
    docs = spark.createDataFrame([("a:b", "c user=alice01 password=hunter22"), ("a", "b:c user=alice01 password=hunter22")], "doc_id string, text string")
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in secrets.find_spans(docs).collect()}
    assert got == {"a:b": [("account", 2), ("assign", 15)], "a": [("account", 4), ("assign", 17)]}


def brute_language(rows):
    """Naive Bayes by dictionaries: id -> (language, posterior)."""
    mask, counts, docs = (1 << 64) - 1, {}, {}

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def grams(text):
        points = [ord(c) if unicodedata.category(c)[0] == "L" else 32 for c in f"  {text.lower()}  "]
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                window = points[i : i + n]
                if set(window) != {32}:
                    value = 0
                    for c in window:
                        value = (value * 0x9E3779B1 + c) & mask
                    yield mix((value * 4 + n) & mask) >> 48

    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            docs[lang] = docs.get(lang, 0) + 1
            counts.setdefault(lang, Counter()).update(grams(text or ""))
    totals = {x: sum(c.values()) + 0.1 * 65536 for x, c in counts.items()}
    out = {}
    for i, text, _ in rows:
        seen = list(grams(text or ""))
        if not seen or not docs:
            out[i] = ("und", 0.0)
            continue
        log = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((counts[x][g] + 0.1) / totals[x]) for g in seen) for x in sorted(docs)}
        best = max(log, key=lambda x: log[x])
        out[i] = (best, 1 / sum(math.exp(v - log[best]) for v in log.values()))
    return out


def test_predictions_equal_naive_bayes_by_dictionaries(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect()]
    rows = sorted(rows)[:60] + [(10**6 + k, t, "en") for k, t in enumerate(["a", "é", "xx yy", "12 !", "", None, "the und", "ΣΑΣ ΟΔΟΣ"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_language(rows)
    for r in language_id.identify(docs).collect():
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, (r, want[r.doc_id])


def test_long_texts_are_cut_into_stretches_without_a_difference():
    text = "Ωμ 1a, b..Ça " * 40
    whole = language_id.features([f"  {text.lower()}  "], [len(text) + 4])[0]
    for limit in (1, 2, 3, 7, 100):
        parts = [language_id.features(p, b)[0] for _, p, b in language_id.stretches([text, None, ""], limit)]
        assert sorted(np.concatenate(parts).tolist()) == sorted(whole.tolist())


def test_too_many_languages_are_refused(spark):
    docs = spark.range(language_id.LANGUAGES + 1).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language_id.learn(docs)


def test_redaction_takes_effect_and_spares_clean_rows(spark, odd, empty):
    docs = spark.createDataFrame([(1, "a password=hunter22 b", 5), (1, "a password=hunter22 b", 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    rows = sorted(((r.doc_id, r.text, r.n_chars) for r in secrets.redact(docs).collect()), key=repr)
    assert rows == [(1, "a [assign] b", 12), (1, "a [assign] b", 12), (2, "clean", 5), (3, None, None)]
    same = secrets.redact(odd)
    assert sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert secrets.redact(empty).collect() == [] == secrets.find_spans(empty).collect()


KEY_ID = "AKIA" + "Q7" * 8
#: A 40-character secret directly behind '=' or ':', next to its key id: text, kinds reported, redacted text.
PAIRS = [
    (1, f"AWS_ACCESS_KEY_ID={KEY_ID}\nAWS_SECRET_ACCESS_KEY={RANDOM}\n", ["access", "random"], "AWS_ACCESS_KEY_ID=[access]\nAWS_SECRET_ACCESS_KEY=[random]\n"),
    (2, f"[default]\naws_access_key_id={KEY_ID}\naws_secret_access_key={RANDOM}", ["access", "random"], "[default]\naws_access_key_id=[access]\naws_secret_access_key=[random]"),
    (3, f"export AWS_SECRET_ACCESS_KEY='{RANDOM}' AWS_ACCESS_KEY_ID={KEY_ID}", ["random", "access"], "export AWS_SECRET_ACCESS_KEY='[random]' AWS_ACCESS_KEY_ID=[access]"),
    (4, f"id:{KEY_ID} key:{RANDOM}", ["access", "random"], "id:[access] key:[random]"),
    (5, f"?AWSAccessKeyId={KEY_ID}&sig={RANDOM}&x=1", ["access", "random"], "?AWSAccessKeyId=[access]&sig=[random]&x=1"),
    (6, f"https://files.example.org/a?sig={RANDOM}", ["endpoint", "random"], "[endpoint]"),
    (7, f"KEY={RANDOM}", [], f"KEY={RANDOM}"),
    (8, f"{KEY_ID} KEY={RANDOM}=", ["access"], f"[access] KEY={RANDOM}="),
    (9, f"{KEY_ID} KEY={RANDOM}x", ["access"], f"[access] KEY={RANDOM}x"),
]


def test_secret_behind_an_equals_sign_is_linked_and_redacted(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in PAIRS], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_spans(docs).collect()}
    assert got == {i: near(t) for i, t, _, _ in PAIRS}
    assert {i: [k for k, _, _ in spans] for i, spans in got.items()} == {i: kinds for i, _, kinds, _ in PAIRS}
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {i: t for i, _, _, t in PAIRS}
