"""The pipeline against a plain version of its five stages, which shares no code with it but the hash of shingles' model constants."""

import math
import random
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_language_secrets import ASSIGN, brute_language

WORDS = {
    "en": "the of and to in is was that for with harbour market river winter letter garden window silver morning teacher village answer station number family bridge forest doctor island summer".split(),
    "de": "der die und das ist nicht mit auf eine für Hafen Brücke Straße Fenster Garten Lehrer Winter Morgen Antwort Familie Wälder Schlüssel Nachricht Dörfer Zeitung Bücher Freunde größer".split(),
}
SECRET = "aB3" * 13 + "x"
KINDS = ["assign", "access", "hex", "account", "random", "endpoint"]
ROLE = {"assign": "secret", "hex": "secret", "random": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}


def rows_of_documents():
    rng, rows = random.Random(21), []

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang]) for _ in range(n))

    for _ in range(40):
        lang = rng.choice(["en", "de"])
        rows.append((prose(lang, rng.choice([40, 90, 200, 1500])), lang))
    for k in range(8):  # near copies: one word of many differs
        words = rows[k][0].split()
        for _ in range(rng.choice([1, 2, 6])):
            if len(words) >= 200:
                at = rng.randrange(len(words))
                rows.append((" ".join([*words[:at], "changed", *words[at + 1 :]]), rows[k][1]))
    for k in range(6):  # exact copies, apart from white space
        rows += [(rows[k + 10][0].replace(" ", " \n", 3), rows[k + 10][1])] * 2
    key_id = "AKIA" + "Q7" * 8
    for k, secret in enumerate([f"password = hunter{22}", f"{key_id} KEY={SECRET}", f"KEY={SECRET}", "user=alice01", "0123456789abcdef" * 2, f"see https://db.example.org/x user=bob42\n\n{SECRET}"]):
        rows.append((f"{prose('en', 60)} case{k} {secret} {prose('en', 30)}", "en"))
    rows += [(None, "en"), ("", None), ("12 34 !!", "de"), ("the", None), ("der die das", None), (prose("en", 20000), None)]
    rng.shuffle(rows)
    return [(i, text, lang, "s", None if text is None else len(text)) for i, (text, lang) in enumerate(rows)]


def weight(often, seen, documents):
    return (1 + math.log(often)) * math.log1p(documents / (2 * documents + seen))


def near_classes(texts):
    """Components of pairs with weighted Jaccard of 0.8 or more, over all pairs; no pair may be near the threshold."""
    bags = {}
    for i, text in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        size = min(5, len(words))
        bags[i] = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()
    seen = Counter(s for bag in bags.values() for s in bag)
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = bags[a].keys() | bags[b].keys()
            w = lambda bag, s: weight(bag[s], seen[s], len(texts)) if bag[s] else 0.0
            most = sum(max(w(bags[a], s), w(bags[b], s)) for s in both)
            similar = sum(min(w(bags[a], s), w(bags[b], s)) for s in both) / most if most else 0.0
            assert not 0.77 < similar < 0.85, (a, b, similar)
            if similar >= 0.8:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in ids}


def redacted(text):
    found = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [("account", *m.span()) for m in re.finditer(r"(?:user(?:name)?|(?:client|account)_id)=[\w.@-]{3,}", text)]
    weak += [("endpoint", *m.span()) for m in re.finditer(r"https://\S+", text)]
    for m in re.finditer("[A-Za-z0-9+/]+", text):
        mixed = all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))
        if len(m[0]) == 40 and mixed and text[m.end() : m.end() + 1] != "=":
            weak.append(("random", *m.span()))
    weak = [w for w in weak if not any(a <= w[1] and w[2] <= b for _, a, b in found)]
    scope = lambda at: len(re.findall(r"\n[\x20\t\r]*\n", text[:at]))
    parts = found + weak
    close = lambda x, y: max(y[1] - x[2], x[1] - y[2]) <= 400 and scope(x[1]) == scope(y[1]) and ROLE[x[0]] != ROLE[y[0]]
    spans = sorted(found + [x for x in weak if any(close(x, y) for y in parts)], key=lambda s: (s[1], KINDS.index(s[0])))
    out, at = "", 0
    for kind, a, b in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def brute(rows):
    spoken = brute_language([(i, text, lang) for i, text, lang, _, _ in rows])
    kept = {i: text for i, text, *_ in rows if spoken[i][0] != "und" and spoken[i][1] >= 0.5}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    classes = near_classes(kept)
    kept = {i: redacted(text) for i, text in kept.items() if classes[i] == i}
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in kept.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for size in [1024] * (len(ids) // 1024) + [1 << k for k in range(9, -1, -1) if len(ids) % 1024 >> k & 1]:
            out.append((i, at, size, zlib.crc32(array("I", ids[at : at + size]).tobytes()), len(ids), size.bit_length() - 1))
            at += size
    return sorted(out), len(classes), kept


def test_run_equals_the_plain_version(spark, tmp_path):
    rows = rows_of_documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, before, kept = brute(rows)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    # every stage had something to do
    assert len(kept) < before < len(rows) - 10 and sum("[random]" in t for t in kept.values()) == 1 and sum(SECRET in t for t in kept.values()) == 2
