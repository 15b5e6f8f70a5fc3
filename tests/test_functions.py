import pytest
from pyspark.sql import functions as F

from larkspur.functions import backoff, pointers, scalars, times
from larkspur.streaming import service


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_pointers():
    assert pointers.parse("/a~1b/~0c/~2") == ["a/b", "~c", "~2"]
    assert pointers.parse("/~01") == ["~1"]
    assert pointers.spark_path("/a~1b/0") == "$['a/b'][0]"
    for bad in ("a", "/", "/a/", "//a", "/*", "/a/**"):
        with pytest.raises(pointers.PointerError):
            pointers.parse(bad)


def test_times(spark):
    good = {"2024-02-29T00:00:00Z": "2024-02-29T00:00:00Z", "2024-01-02t03:04:05.1203z": "2024-01-02T03:04:05.1203Z", "2024-01-01T00:00:00+23:59": "2023-12-31T00:01:00Z"}
    bad = ["2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00+24:00", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00.1234567890Z"]
    for text, out in good.items():
        assert times.utc(*times.parse(text)) == out
    for text in bad:
        with pytest.raises(ValueError):
            times.parse(text)
    assert values(spark, times.utc_column(F.col("t")), [("2024-01-02T03:04:05.120300000-01:00",), ("nonsense",)], "t string") == ["2024-01-02T04:04:05.1203Z", None]


def test_scalars(spark):
    assert values(spark, scalars.url_encoded(F.col("t")), [("a b*~/",)], "t string") == ["a%20b%2A~%2F"]
    assert values(spark, scalars.safe_token(F.col("t")), [(" a//b--c. ",)], "t string") == ["a-b--c."]
    assert values(spark, scalars.int64(F.col("t")), [("12",), (" 12",), ("9223372036854775808",), ("-9223372036854775808",), ("x",)], "t string") == [12, None, None, -(1 << 63), None]
    assert [None if v is None else int(v) for v in values(spark, scalars.uint64(F.col("t")), [("18446744073709551615",), ("18446744073709551616",), ("-1",)], "t string")] == [(1 << 64) - 1, None, None]
    assert values(spark, scalars.effective_namespace(F.col("n"), F.col("d")), [("a", "b"), ("", "b"), (None, "")], "n string, d string") == ["a", "b", "default"]
    assert values(spark, scalars.queue_state_key(F.col("q"), F.col("m")), [("q", "1"), ("", "1"), ("q", None)], "q string, m string") == ["q/q/state/1", None, None]
    assert values(spark, scalars.text_or_base64(F.col("b")), [(bytearray(b"hi"),), (bytearray(b"\x00\xff\x01"),), (bytearray(b"a\x00"),)], "b binary") == ["hi", "AP8B", "YQA="]
    assert values(spark, scalars.base64(F.col("b")), [(bytearray(b"x" * 100),)], "b binary") == ["eHh4" * 33 + "eA=="]


def test_backoff(spark):
    assert [r[0] for r in spark.range(1, 9).select(backoff.restart_delay_ms(F.col("id"))).collect()] == [0, 0, 0, 250, 500, 1000, 2000, 4000]
    assert values(spark, backoff.jittered(F.col("d"), F.lit(100), F.col("u")), [(250, 0.0), (250, 1.0), (50, 0.0), (300000, 1.0)], "d long, u double") == [150, 350, 0, 300000]
    assert values(spark, backoff.jittered(F.col("d"), F.lit(100), F.col("u")), [(0, 1.0), (50, 1.0)], "d long, u double") == [0, 100]
    for immediate, base, factor, cap in ((3, 250, 2.0, 300_000), (0, 250, 1.02, 300_000), (1, 250, 1.0, 9_000), (2, 250, 1.001, 9_000), (-1, 5_000, 3.0, 1_000)):
        policy = service.Policy(0, immediate, base, factor, cap)
        told = spark.range(1, 600).select(backoff.restart_delay_ms(F.col("id"), immediate, base, factor, cap)).collect()
        assert [r[0] for r in told] == [policy.delay_ms(n) for n in range(1, 600)]
    assert values(spark, backoff.is_fatal(F.col("c"), F.col("h")), [("invalid", None), (None, 404), (None, 429), (None, 503), ("transport", None)], "c string, h int") == [True, True, False, False, False]
    assert values(spark, backoff.extend_after_ms(F.col("v")), [(0,), (10,), (100,)], "v long") == [250, 5000, 30000]
