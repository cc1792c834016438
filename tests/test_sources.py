import struct

import pytest

from factloom.sources import readers, tables


def frame(data):
    return struct.pack("<Q", len(data)) + b"crc1" + data + b"crc2"


def test_length_prefixed_records(spark, tmp_path):
    spark.dataSource.register(readers.LengthPrefixedSource)
    (tmp_path / "a").write_bytes(frame(b"one") + frame(b"") + frame(b"three"))
    rows = spark.read.format("length_prefixed").load(str(tmp_path / "a")).orderBy("ordinal").collect()
    assert [bytes(r.record) for r in rows] == [b"one", b"", b"three"]
    (tmp_path / "b").write_bytes(frame(b"one")[:-2])
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("length_prefixed").load(str(tmp_path / "b")).collect()


def test_json_lines_keep_what_does_not_fit(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    (tmp_path / "x.json").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = readers.json_lines(spark, str(tmp_path / "x.json"), StructType([StructField("a", LongType())])).collect()
    assert sorted(r.a for r in rows if r._corrupt is None) == [1, 2]
    assert [r._corrupt for r in rows if r._corrupt] == ["not json"] and rows[0]._file == "x.json"


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": 1, "a": 2}\n{"a": NaN}\n[1]\n{"a"\n')
    rows = readers.strict_json_lines(spark, str(tmp_path / "x.json"), "a bigint").collect()
    assert [r.status for r in rows] == ["OK", "REPEATED_KEY", "NOT_FINITE", "NOT_AN_OBJECT", "NOT_JSON"]
    assert rows[0].value.a == 1 and rows[1].value is None


def test_growing_file_loses_its_open_line(spark, tmp_path):
    (tmp_path / "log").write_text("one\ntwo\nthr")
    assert [r.line for r in readers.complete_lines(spark, str(tmp_path / "log")).collect()] == ["one", "two"]


def test_versions_are_written_once(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "v1")
    assert tables.write_versioned(df, path) == "WRITTEN"
    assert tables.write_versioned(df, path, resume=True) == "UNCHANGED"
    with pytest.raises(FileExistsError):
        tables.write_versioned(df, path)
    with pytest.raises(ValueError):
        tables.write_versioned(spark.range(6), path, resume=True)
