import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import near_dedup
from larkspur.llm.components import components
from larkspur.llm.skew import spread_join


def brute(rows, frequency):
    """Classes by comparing all pairs of texts."""
    parsed = []
    for _, text in rows:
        _, h, often = near_dedup.shingles(pa.array([text or ""]))
        parsed.append((h, frequency.weight(h, often)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dedup.weighted_jaccard(parsed[i], parsed[j]) >= near_dedup.THRESHOLD:
                parent[find(i)] = find(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        if i is not None:
            names[root] = min(i, names.get(root, i))
    return sorted(((i, names.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        for copy in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            for _ in range(copy):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    hot = [rng.choice(words) for _ in range(150)]
    for _ in range(60):  # a large group of near copies, each with an edit of its own
        text = list(hot)
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((n, " ".join(text)))
        n += 1
    return rows


def got(frame):
    return sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect()), key=repr)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = got(docs)
    assert found == brute(rows, near_dedup.document_frequency(docs))
    assert sum(c == min(i for i, _ in rows[-60:]) for _, c in found) == 60


def test_recall_on_a_whole_documents_table(spark):
    """Against all pairs: no document too many in a class, and at least 0.9 of the similar pairs in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    frequency = near_dedup.document_frequency(docs)
    row, h, often = near_dedup.shingles(pa.array([r.text or "" for r in rows]))
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    weights = frequency.weight(h, often)
    parsed = [(h[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:])]
    similar = [(i, j) for i in range(len(rows)) for j in range(i) if near_dedup.weighted_jaccard(parsed[i], parsed[j]) >= near_dedup.THRESHOLD]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    caught = [found[rows[i].doc_id] == found[rows[j].doc_id] for i, j in similar if rows[i].text != rows[j].text]
    print(f"{len(rows)} documents, {len(similar)} similar pairs, {len(caught)} of different texts, recall {np.mean(caught):.4f}")
    assert len(caught) > 10 and np.mean(caught) >= 0.9
    whole = dict(brute([(r.doc_id, r.text) for r in rows], frequency))
    assert all(whole[i] == whole[c] for i, c in found.items())


def test_the_last_search_finds_what_leaders_miss(spark, monkeypatch):
    """One leader round, blocks of a few rows, and groups whose members are far from each other."""
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 2)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 3)
    rng = random.Random(5)
    base, rows = [f"v{i}" for i in range(90)], []
    for n in range(70):  # a chain: neighbours are close, far ones are not
        base = list(base)
        base[rng.randrange(90)] = f"v{rng.randrange(400)}"
        rows.append((n, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs) == brute(rows, near_dedup.document_frequency(docs))


def test_odd_rows(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], near_dedup.document_frequency(odd))
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({c for _, c in got(odd)})
    assert near_dedup.classes(empty).collect() == [] == near_dedup.keep_one(empty).collect()


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(500)]
    other = base[:450] + [str(rng.random()) for _ in range(50)]
    column = pa.array([" ".join(base), " ".join(other)])
    flat = near_dedup.Frequency(np.zeros(near_dedup.CELLS, np.int64), 100)
    row, h, often = near_dedup.shingles(column)
    w = flat.weight(h, often)
    similarity = near_dedup.weighted_jaccard((h[row == 0], w[row == 0]), (h[row == 1], w[row == 1]))
    assert similarity == pytest.approx(446 / 546, abs=0.02)
    same = (near_dedup.band_keys(column, flat)[0] == near_dedup.band_keys(column, flat)[1]).mean()
    assert abs(same - similarity**near_dedup.ROWS) < 0.35


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_rows_that_share_an_id_are_told_apart(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(3, text), (5, text), (5, "quite another text with words of its own here"), (5, "quite another text with words of its own here")], "doc_id long, text string")
    docs = docs.union(spark.createDataFrame([(5, "a third text that is like none of the other two texts")], docs.schema))
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    assert kept == [(3, text), (5, "a third text that is like none of the other two texts"), (5, "quite another text with words of its own here")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, how):
    rows = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 5), (2, 5), (3, 7), (None, 8)], "k long, v long").repartition(4)
    table = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, w string")
    found = [sorted(map(tuple, f.select("k", "v", "w").collect()), key=repr) for f in (spread_join(rows, table, "k", "v", how), rows.join(table, "k", how))]
    assert found[0] == found[1]


def test_copies_without_ids_are_one_class(spark):
    """Rows that nothing tells apart, more of them than salts."""
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text)] * 50 + [(4, text)] * 50, "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in near_dedup.classes(docs).distinct().collect() if r.doc_id] == [(4, 4, 100)]
    assert near_dedup.classes(docs).count() == 100
