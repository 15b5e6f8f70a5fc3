import pytest

from larkspur.sources import bytes_io


def pull(part):
    for i in range(3):
        yield f"{part}-{i}".encode()


def test_memory_round_trip_and_limit(spark):
    df = bytes_io.from_memory(spark, [b"ab", b"\x00\xff"])
    assert sorted(bytes_io.to_memory(df)) == [b"\x00\xff", b"ab"]
    with pytest.raises(ValueError):
        bytes_io.to_memory(df, limit_bytes=3)


def test_copy_counts_bytes(spark, tmp_path):
    df = bytes_io.from_memory(spark, [b"abc", b"", b"de"])
    assert bytes_io.copy(df, str(tmp_path / "out")).first().written == 5


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert bytes(bytes_io.from_files(spark, str(tmp_path), "*.txt").first().content) == b"one\ntwo"
    assert bytes_io.from_text_files(spark, str(tmp_path / "a.txt")).first().value == "one\ntwo"
    (tmp_path / "b.json").write_text('{"key":"resource/1"}\n{"key":"resource/2"}\n')
    assert [r.key for r in bytes_io.ndjson(spark, str(tmp_path / "b.json"), "key string").collect()] == ["resource/1", "resource/2"]


def test_callback_source_reads_every_partition(spark):
    rows = bytes_io.from_callback(spark, "tests.test_sources:pull", partitions=2).collect()
    assert sorted(bytes(r.content) for r in rows) == [b"0-0", b"0-1", b"0-2", b"1-0", b"1-1", b"1-2"]


def test_callback_sink_sees_errors(spark):
    def fail(data):
        raise RuntimeError("sink")

    with pytest.raises(Exception, match="sink"):
        bytes_io.to_callback(bytes_io.from_memory(spark, [b"a"]), fail)
