import math
import re
import zlib
from collections import Counter

import numpy as np

from larkspur.llm import brown_lm
from larkspur.llm.text_arrays import Words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check(rows, got):
    counts, ends = Counter(), 0
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(tokens(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for i, text in rows:
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), n, round(base, 4)))
    have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 1 << 17)  # several blocks
    docs = documents.select("doc_id", "text").repartition(2, "doc_id").cache()
    rows = brown_lm.score(docs, sweeps=2).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows)
    held = [r for r in rows if r.held_out]
    # class bigrams beat add-half unigrams on texts they have not seen
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows_and_empty_table(odd, empty):
    check([(r.doc_id, r.text) for r in odd.collect()], brown_lm.score(odd, sweeps=1).collect())
    assert brown_lm.score(empty, sweeps=1).collect() == []


def test_no_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    rows = brown_lm.score(docs, sweeps=1).collect()
    check([(i, "some words") for i in held], rows)


def test_exchange_raises_likelihood():
    """Words that share contexts end up together when a few classes are exchanged."""
    classes = brown_lm.CLASSES
    pairs = np.zeros((classes, classes), np.int64)
    pairs[0, 1] = pairs[2, 3] = 500
    pairs[1, 0] = pairs[3, 2] = 500
    before, behind = np.zeros((2, classes), np.int64), np.zeros((2, classes), np.int64)
    before[0, 0], behind[0, 0] = 50, 50
    before[1, 2], behind[1, 2] = 50, 50
    assert brown_lm.best_classes(before, behind, np.array([30, 30]), pairs).tolist() == [1, 3]
    assert brown_lm.best_classes(before * 0, behind * 0, np.array([4, 5]), pairs).tolist() == [4, 5]


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (brown_lm.CLASSES, brown_lm.CLASSES))
    table = brown_lm.ClassBigrams.of(pairs)
    assert np.allclose((10**table.log10).sum(axis=1), 1)


def brute(rows):
    """Scores by single-process exchange over a table of all words, in the order of their hashes."""
    end, classes = brown_lm.END, brown_lm.CLASSES
    texts = [(i, tokens(t), zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    names = sorted({w for _, t, _ in texts for w in t}, key=word_hash)
    number = {w: k for k, w in enumerate(names)}
    train = [[number[w] for w in t] for _, t, held in texts if not held]
    counts = Counter(w for t in train for w in t)
    own = np.full(len(names), end - 1)
    for c, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:end]):
        own[w] = c

    def contexts(own):
        pairs = np.zeros((classes, classes), np.int64)
        before, behind = np.zeros((2, len(names), classes), np.int64)
        for t in train:
            chain = [end, *(own[w] for w in t), end]
            for k, w in enumerate(t):
                before[w, chain[k]] += 1
                behind[w, chain[k + 2]] += 1
        chain = [c for t in train for c in [*(own[w] for w in t), end]]
        np.add.at(pairs, ([end, *chain[:-1]], chain), 1)
        return own, pairs, before, behind

    now, done, idle = contexts(own), 0, 0
    while idle < 2:
        best = brown_lm.best_classes(now[2], now[3], now[0], now[1])
        tried = contexts(np.where(np.arange(len(names)) % 2 == done % 2, best, now[0]))
        rise = brown_lm.likelihood(tried[1]) - brown_lm.likelihood(now[1])
        done, idle = done + 1, 0 if rise > brown_lm.TOLERANCE else idle + 1
        now = tried if rise > 0 else now
    own, pairs = now[:2]
    log10 = brown_lm.ClassBigrams.of(pairs).log10
    n, v = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        n[own[w]] += c
        v[own[w]] += 1
    out = {}
    for i, t, _ in texts:
        words = [number[w] for w in t]
        chain = [end, *(own[w] for w in words), end]
        score = sum(log10[a, b] for a, b in zip(chain[:-1], chain[1:], strict=True))
        out[i] = round(score + sum(math.log10((counts[w] + 0.5) / (n[own[w]] + 0.5 * (v[own[w]] + 1))) for w in words), 6)
    return out, done


def word_hash(word):
    raw = word.encode()
    return int(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash[0])


def test_each_word_has_a_class_and_sweeps_end_by_the_likelihood(spark, monkeypatch):
    """Words whose hashes agree in 17 bits are classed apart, and scores equal a brute-force version."""
    many = [f"w{i}" for i in range(3000)]
    shared = {}
    for w in many:
        shared.setdefault(word_hash(w) >> 47, []).append(w)
    twins = next(ws for ws in shared.values() if len(ws) > 1)[:2]
    rng = np.random.default_rng(1)
    kinds = [["red", "blue", twins[0]], ["cat", "dog", twins[1]], many[:40], many[40:80]]
    texts = [" ".join(str(rng.choice(kinds[k])) for _ in range(6) for k in (0, 1, 2, 3)) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    want, done = brute(rows)
    assert done > 2
    assert {r.doc_id: round(r.score, 6) for r in brown_lm.score(docs).collect()} == want
    monkeypatch.setattr(brown_lm, "PART_BYTES", 1 << 10)  # several parts and blocks
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 1 << 11)
    check(rows, brown_lm.score(docs, sweeps=2).collect())


def test_a_sweep_reads_one_row_of_texts_for_each_block(spark, documents, monkeypatch):
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 1 << 17)
    docs = documents.selectExpr("doc_id", "doc_id % 3 = 1 as held_out", "coalesce(text, '') as text").repartition(2, "doc_id").cache()
    rows = brown_lm._encode(docs, 1).where("part is null or part < 0").collect()
    blocks = {r.block for r in rows}
    assert len(blocks) > 1
    assert sorted((r.block, r.part) for r in rows if r.data is not None) == sorted((b, p) for b in blocks for p in (-1, -2))
    assert sorted(r.doc_id for r in rows if r.data is None) == sorted(r.doc_id for r in docs.collect())
