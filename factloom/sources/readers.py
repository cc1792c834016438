"""Readers: JSON lines with error places, nested documents, records in binary files, snapshots."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.parse import strict_json


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON-lines files (also gzip) with ``_corrupt`` (the line, where it doesn't fit) and ``_file``.

    Blank lines are skipped. Only the schema's fields are read.
    """
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_name"))


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(value, status, line): lines that hold strict objects, and why others don't: repeated keys and
    non-finite numbers count as errors."""
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0)
    checked = lines.withColumn("checked", strict_json(F.col("value")))
    ok = F.col("checked.status") == "OK"
    return checked.select(F.when(ok, F.from_json("value", schema)).alias("value"), F.col("checked.status").alias("status"), F.when(~ok, F.col("value")).alias("line"))


def annotation_rows(scenes: DataFrame, limit: int | None = None) -> DataFrame:
    """scene, branches (array of struct(change, questions array of struct(id, question, answer))) to one row
    per question with the ordinals of branch and question."""
    branches = scenes.select("scene", F.posexplode("branches").alias("branch_ordinal", "branch"))
    rows = branches.select("scene", "branch_ordinal", F.col("branch.change").alias("change"), F.posexplode("branch.questions").alias("question_ordinal", "q"))
    out = rows.select("scene", "branch_ordinal", "change", "question_ordinal", "q.*")
    return out if limit is None else out.orderBy("scene", "branch_ordinal", "question_ordinal").limit(limit)


def json_object_entries(documents: DataFrame, column: str) -> DataFrame:
    """(key, value) of the top-level object in each document, values as VARIANT."""
    v = F.try_parse_json(column).alias("_v")
    return documents.select(v).where("_v is not null").lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("key", "value")


def tsv_with_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole lines of a text file that may still grow: a last line without an end is left out.

    The file is read as it is when the plan starts; the digest is that of the lines kept.
    """
    whole = spark.read.text(path, wholetext=True)
    cut = F.regexp_replace("value", r"[^\n]*\z", "")
    return whole.select(F.sha2(cut, 256).alias("digest"), F.explode(F.split(F.regexp_replace(cut, r"\n\z", ""), "\n")).alias("line")).where(F.length("line") > 0)


class LengthPrefixedSource(DataSource):
    """``spark.read.format("length_prefixed")``: records of TFRecord framing.

    Each record is a little-endian length of 8 bytes, a checksum of 4, the data and a checksum of 4; checksums
    aren't verified, a file that ends inside a record raises. A partition is one file of ``path``
    (comma-separated local or shared paths); records are streamed, never whole files.
    """

    @classmethod
    def name(cls) -> str:
        return "length_prefixed"

    def schema(self) -> str:
        return "file string, ordinal bigint, record binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LengthPrefixedReader(self.options)


class LengthPrefixedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value.removeprefix("file://"), "rb") as f:
            ordinal = 0
            while head := f.read(12):
                if len(head) < 12:
                    raise ValueError(f"{partition.value} ends inside a record")
                (size,) = struct.unpack("<Q", head[:8])
                data = f.read(size)
                if len(data) < size or len(f.read(4)) < 4:
                    raise ValueError(f"{partition.value} ends inside a record")
                yield partition.value, ordinal, data
                ordinal += 1
