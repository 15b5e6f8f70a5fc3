"""The mutation language, by examples of input and output."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.operators.mutate import mutate, mutate_text
from larkspur.plans.mutations import MutationError, Parser

CLOCK = (1_700_000_000, 123_456_789)
FILES = {"blob.txt": b'hello\n"quoted"', "blob.bin": b"\x00\x01\x02a", "text": b"hello world", "ff.bin": b"\x00\xff\x01", "bad": b"\xff"}


def apply(doc, *expressions):
    return mutate_text(doc, Parser(CLOCK, FILES.__getitem__).plan(list(expressions)))


@pytest.mark.parametrize(
    ("doc", "expressions", "out"),
    [
        ('{"id":"a"}', ["textfile:/meta/blob=blob.txt"], '{"id":"a","meta":{"blob":"hello\\n\\"quoted\\""}}'),
        ("{}", ["time:/ts=NOW"], '{"ts":"2023-11-14T22:13:20.123456789Z"}'),
        ("{}", ["time:/ts=2024-01-02T03:04:05+02:30"], '{"ts":"2024-01-02T00:34:05Z"}'),
        ("{}", ["time:/ts=2024-01-02T03:04:05.120300000-01:00"], '{"ts":"2024-01-02T04:04:05.1203Z"}'),
        ('{"counter":1,"drop":2,"keep":3}', ["/counter++", "rm:/drop"], '{"counter":2,"keep":3}'),
        ("{}", ["/stats/views++"], '{"stats":{"views":1}}'),
        ('{"items":["old","keep"]}', ['/items/0="new"'], '{"items":["new","keep"]}'),
        ('{"items":["old","keep"]}', ["rm:/items/0"], '{"items":["keep"]}'),
        ('{"keep":1}', ["rm:/optional/field"], '{"keep":1}'),
        ('{"items":["keep"]}', ["rm:/items/5"], '{"items":["keep"]}'),
        ('{"payload":"old"}', ["base64file:/payload=blob.bin"], '{"payload":"AAECYQ=="}'),
        ('{"payload":"old"}', ["file:/payload=text"], '{"payload":"hello world"}'),
        ('{"payload":"old"}', ["file:/payload=ff.bin"], '{"payload":"AP8B"}'),
        ('{"counter":1}', ["/counter=2"], '{"counter":3}'),
        ("{}", ['/n="5"'], '{"n":5}'),
        ("{}", ['/b="true"', "/c=FALSE", "/d=Null"], '{"b":true,"c":false,"d":null}'),
        ("{}", ["/x="], '{"x":""}'),
        ("{}", ["/x=0x10"], '{"x":16}'),
        ("{}", ["/name=C++"], '{"name=C":1}'),
        ("{}", ["/z=y"], '{"z":"y"}'),
        ("{}", ["time:/a{/b=NOW}"], '{"a":{"b":"NOW"}}'),
        ("{}", ["/a{/b=x,/c++,/d{/e=1\n/f=q}}"], '{"a":{"b":"x","c":1,"d":{"e":1,"f":"q"}}}'),
        (None, ["/a=b"], '{"a":"b"}'),
        ('{"z":2.50,"a":1e3}', ["/k=v"], '{"z":2.50,"a":1e3,"k":"v"}'),
        ('{ "a" : 1 }', ["rm:/b"], '{ "a" : 1 }'),
        ("{}", ["/a~1b=x", "/c~0d=y"], '{"a/b":"x","c~d":"y"}'),
    ],
)
def test_golden(doc, expressions, out):
    assert apply(doc, *expressions) == out


@pytest.mark.parametrize(
    ("doc", "expression", "message"),
    [
        ('{"counter":"one"}', "/counter++", "increment target is not numeric"),
        ("{}", '/items/0="x"', "missing array paths"),
        ("{}", "/items/0++", "missing array paths"),
        ("{}", "time:/ts=2024-13-02T03:04:05Z", "invalid time"),
        ('{"broken', "time:/ts=NOW", "invalid JSON"),
        ("{}", "textfile:/a=bad", "invalid UTF-8"),
        ("{}", "/x=0", "non-zero"),
        ("{}", "/x=inf", "finite"),
        ("{}", "novalue", "invalid mutation"),
        ("{}", "/=x", "document root"),
        ("{}", "/a/*=x", "wildcards"),
        ("{}", "rm:time:/a", "time:"),
        ("{}", "", "no mutations"),
        ("{}", "/a={}", "no mutations"),
    ],
)
def test_errors(doc, expression, message):
    with pytest.raises(MutationError, match=message):
        apply(doc, expression)


def test_files_stay_below_the_base_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x")
    (tmp_path / "secret").write_text("y")
    assert mutate_text("{}", Parser(base_dir=str(tmp_path / "in")).plan(["file:/p=a"])) == '{"p":"x"}'
    with pytest.raises(MutationError, match="below"):
        Parser(base_dir=str(tmp_path / "in")).plan(["file:/p=../secret"])


def test_rows_with_errors_are_kept_when_not_strict(spark):
    docs = spark.createDataFrame([('{"n":1}',), ('{"n":"a"}',), (None,)], "doc string")
    rows = mutate(docs, Parser().plan(["/n++"]), strict=False).collect()
    assert [(r.doc, r.mutation_error) for r in rows] == [('{"n":2}', None), (None, "increment target is not numeric"), ('{"n":1}', None)]


_keys = st.text(st.characters(codec="utf-8", exclude_characters="/~"), min_size=1, max_size=4).filter(lambda k: not k.isdigit() and k not in ("*", "**", "[]", "..."))


@given(st.dictionaries(_keys, st.integers(-1000, 1000) | st.text(max_size=5) | st.booleans() | st.none(), max_size=5), _keys)
def test_set_then_remove_restores_the_document(doc, key):
    from larkspur.plans.mutations import Step

    text = json.dumps(doc)
    made = json.loads(mutate_text(text, [Step("set", (key,), "v")]))
    assert made == {**doc, key: "v"}
    gone = json.loads(mutate_text(json.dumps(made), [Step("remove", (key,))]))
    assert gone == {k: v for k, v in doc.items() if k != key}


def test_odd_documents_and_paths():
    plan = Parser().plan(["/k++"])
    assert mutate_text('{"a":"\\ud800x\\ud83d\\ude00"}', plan) == '{"a":"\\ud800x😀","k":1}'
    for doc in ('{"a":1,"a":2}', "[", '{"k":NaN}'):
        with pytest.raises(MutationError):
            mutate_text(doc, plan)
    assert mutate_text('{"a":{}}', Parser().plan(["/a/²=x"])) == '{"a":{"²":"x"}}'
    with pytest.raises(MutationError):
        mutate_text('{"a":[1]}', Parser().plan(["/a/²=x"]))
    assert [s.path for s in Parser().plan(['/a{/b=x,/c="y,/d=z}'])] == [("a", "b"), ("a", "c")]
