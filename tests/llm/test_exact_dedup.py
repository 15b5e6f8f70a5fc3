import hashlib
import re
from collections import defaultdict

from larkspur.llm import exact_dedup
from larkspur.llm.queries import oracle_sql, queries
from tests.compare import assert_same


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_matches_sql(spark, data):
    assert_same(queries()["op10_exact_dedup"](spark, data), oracle_sql()["op10_exact_dedup"], data)


def test_odd_rows_match_brute_force(odd):
    got = sorted(map(tuple, exact_dedup.deduplicate(odd).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_keep_first_leaves_one_row_of_each_content(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 4, 5, 6, 8, 9, 10, 11, None], key=str)


def test_empty_table(empty):
    assert exact_dedup.deduplicate(empty).collect() == []
    assert exact_dedup.keep_first(empty).collect() == []


def test_no_python_in_the_plan(odd):
    plan = exact_dedup.deduplicate(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
