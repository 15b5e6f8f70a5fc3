"""Every query of the engine gives the rows of its SQL."""

import pytest

from larkspur import queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), queries.SQL[name], data)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_index_engine_pushes_the_filter(spark, data, tmp_path):
    from larkspur.operators import query as q

    docs = queries._all_namespaces(queries._docs(spark, data))
    indexed, mapping = q.build_index(docs, [("/k", "bigint")])
    q.write_index(indexed, str(tmp_path / "index"))
    table = spark.read.parquet(str(tmp_path / "index"))
    wanted = q.Query({"eq": {"field": "/k", "value": 69}}, returns="keys", engine="index")
    found = q.run(table, wanted, mapping)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ix_k,69)" in plan and "PartitionFilters: [isnotnull(namespace" in plan
    scanned = q.run(docs, q.Query({"eq": {"field": "/k", "value": 69}}, returns="keys"))
    assert sorted(r.key for r in found.collect()) == sorted(r.key for r in scanned.collect())


def test_pages_cover_all_matches_once(spark, data):
    from larkspur.operators import query as q

    docs = queries._all_namespaces(queries._docs(spark, data)).cache()
    wanted = q.Query({"range": {"field": "/k", "lt": 30}}, returns="keys", limit=50)
    paged = [r.key for page in q.pages(docs, wanted) for r in page.collect()]
    whole = [r.key for r in q.run(docs, q.Query(wanted.selector, returns="keys")).collect()]
    assert len(paged) == len(set(paged)) and sorted(paged) == sorted(whole)


def test_selector_types_are_strict(spark):
    from larkspur.operators import query as q

    docs = spark.createDataFrame([("default", str(i), d) for i, d in enumerate(['{"k":1}', '{"k":"1"}', '{"k":1.0}', '{"k":true}', '{"k":null}', "{}", "not json", None])], "namespace string, key string, doc string")
    keys = lambda s: sorted(r.key for r in q.run(docs, q.Query(s, returns="keys")).collect())
    assert keys({"eq": {"field": "/k", "value": 1}}) == ["0"]
    assert keys({"eq": {"field": "/k", "value": "1"}}) == ["1"]
    assert keys({"eq": {"field": "/k", "value": True}}) == ["3"]
    assert keys({"eq": {"field": "/k", "value": None}}) == ["4"]
    for empty in ("", {}):
        with pytest.raises(ValueError):
            q.run(docs, q.Query(empty))


def test_key_stream_hands_over_keys_and_stops_on_errors(spark, data):
    from larkspur.operators import query as q

    keys = spark.range(5).selectExpr("cast(id as string) as key")
    seen = []
    assert q.stream_keys(keys, lambda: seen.append("begin"), seen.append, lambda: seen.append("end")) == 5
    assert seen[0] == "begin" and seen[-1] == "end" and len(seen) == 7

    def fail(_key):
        raise RuntimeError("handler")

    with pytest.raises(RuntimeError):
        q.stream_keys(keys, lambda: None, fail, lambda: None)


def test_every_lease_is_handed_over_as_a_write(spark, data, monkeypatch):
    handed = []
    real = queries.leases.fenced_writes
    monkeypatch.setattr(queries.leases, "fenced_writes", lambda writes, rows, now: handed.append((writes, rows)) or real(writes, rows, now))
    kept = queries.QUERIES["lease_fenced_writes"](spark, data).count()
    writes, rows = handed[0]
    current = queries.leases.current(rows).count()
    assert writes.select("key", "lease_id").exceptAll(rows.select("key", "lease_id")).isEmpty()
    assert writes.count() == rows.count() and 0 < kept < current
    # writes of the others were refused for their token alone
    assert real(rows, rows, 0).count() == current


def test_update_under_leases_sorts_no_versions_or_leases_of_other_keys(spark, data):
    plan = queries.QUERIES["lease_acquire_for_update"](spark, data)._jdf.queryExecution().executedPlan().toString()
    lines = plan[: plan.find("== Initial Plan ==") if "== Initial Plan ==" in plan else None].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    numbered = [i for i, line in enumerate(lines) if "Window [row_number()" in line and " ts#" in line]
    assert len(numbered) == 2
    for i in numbered:  # below the numbering and its sort the rows of other keys are gone, without a sort of them
        assert "Sort [" in lines[i + 1] and "ShuffledHashJoin" in lines[i + 2] and "LeftSemi" in lines[i + 2], lines[i : i + 3]
        assert depth[i] < depth[i + 1] < depth[i + 2]
    assert "LeftAnti" not in plan


@pytest.mark.parametrize("name", ["state_write_after_remove", "state_set_hidden"])
def test_versions_that_are_read_several_times_are_numbered_once(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "row_number()" in line and " ts#" in line]


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "boolean"])
def test_index_engine_gives_the_rows_of_a_scan(spark, kind):
    """Every leaf, over values of every type, with an index column of every type."""
    from larkspur.operators import query as q

    values = ["1", "1.0", "2.7", "3", '"a"', '"1"', "true", "null", "-0.0", "0", "9223372036854775807", "9223372036854775808", "1e3", '""', "[1]", '{"x":1}']
    rows = [("default", f"{i:02d}", f'{{"k":{v}}}') for i, v in enumerate(values)] + [("default", "98", "{}"), ("default", "99", "no json")]
    docs = spark.createDataFrame(rows, "namespace string, key string, doc string").coalesce(1)
    indexed, mapping = q.build_index(docs, [("/k", kind)])
    leaves = [{"eq": {"field": "/k", "value": v}} for v in (1, 1.0, 2.7, 0, 0.0, 3.0, "1", "a", "", True, False, None, 9223372036854775807, 9223372036854775808, 1000)]
    leaves += [{"range": {"field": "/k", **b}} for b in ({"gt": 1.5}, {"gte": 1}, {"lt": 3}, {"lte": 2.7, "gt": -1})] + [{"prefix": {"field": "/k", "value": p}} for p in ("", "a")]
    leaves += [{"not": leaf} for leaf in leaves] + [{"in": {"field": "/k", "values": [1, "a", 2.7]}}, {"exists": {"field": "/k"}}]
    both = {"scan": docs, "index": indexed}
    found = {e: [sorted(r.key for r in q.candidates(d, q.Query(leaf, engine=e), mapping).collect()) for leaf in leaves] for e, d in both.items()}
    assert found["scan"] == found["index"] and found["scan"][0] == ["00"]


def test_metadata_of_several_queries_reads_the_documents_once(spark):
    from larkspur.operators import query as q

    docs = spark.createDataFrame([("default", "a", '{"k":1}'), ("default", "b", '{"k":2}'), ("other", "c", '{"k":1}')], "namespace string, key string, doc string")
    wanted = [q.Query({"k": v}) for v in (1, 2, 3)]
    told = q.metadata_each(docs, wanted)
    assert [(r.query, r.query_candidates, r.query_matches, r.cursor) for r in told.collect()] == [(0, 2, 1, "a"), (1, 2, 1, "b"), (2, 2, 0, None)]
    assert [q.metadata(docs, w).first() for w in wanted] == told.drop("query").collect()
