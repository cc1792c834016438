"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is in ``split_words``: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session has none (as in tests) a temporary folder is made and
    kept in the session's settings; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    stages before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, whose keys are unique and whose column ``count`` (dropped) says how
    many rows of ``left`` have them.

    Keys that more than a thousandth of ``total`` rows have, of which there are at most 1,000, are
    broadcast, so their rows stay where they are; only the others are shuffled. Both
    should be written tables, since each is read twice. Rows of ``left`` with null keys have no partner.
    """
    often = F.col(count) > max(1_000, total // 1_000)
    hot = right.where(often).drop(count)
    if not hot.limit(1).count():
        return left.join(right.drop(count), keys, how)
    crowd = left.join(F.broadcast(hot.select(*keys)), keys, "left_semi").join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~often).drop(count), keys, how)
    return crowd.unionByName(rest)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def held_out(id_column: Column) -> Column:
    """The fold that no model learns labels from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")), F.lit(0)) % 5 == 0
