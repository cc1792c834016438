"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none, a temporary folder, kept in its settings."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again: cuts the lineage of iterations."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go when the write or query that made them is done, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write in the shared folder as a table bucketed by ``key`` and read again: windows and groups by it and more columns are then made where its
    rows lie, without another shuffle, and so are joins planned in ``in_place``. There are as many buckets as shuffle partitions (see ``spread``)."""
    spark, table = df.sparkSession, f"factloom_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with cleaned(spark):
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/factloom/{table}").saveAsTable(table)
    return spark.table(table)


#: Rows of a bucket at most, on the average, of tables that are dealt within ``spread``.
BUCKET_ROWS = 50_000


@contextlib.contextmanager
def spread(rows: DataFrame) -> Iterator[None]:
    """While it lasts, there are so many shuffle partitions, and thus buckets of ``dealt``, that each gets BUCKET_ROWS of ``rows`` or fewer. What a task builds
    for its joins can't be spilled, so tasks must become more and not larger as rows do. Fewer partitions than are set already are never made."""
    spark, name = rows.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    spark.conf.set(name, str(max(int(before), min(most, -(-rows.count() // BUCKET_ROWS)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_by(table: str) -> Callable:
    """Of a query that takes tables by name: its body runs within ``spread`` of one of them."""

    def of(run: Callable) -> Callable:
        @functools.wraps(run)
        def spread_run(t):
            with spread(t(table)):
                return run(t)

        return spread_run

    return of


@contextlib.contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins by several columns need no shuffle if both sides are dealt by one of them. Plans are made when they run, so run them within."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def digest(df: DataFrame) -> tuple:
    """Rows and an order-free hash of a table: equal tables have equal digests."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def write_versioned(df: DataFrame, path: str, resume: bool = False) -> str:
    """Write a version once. Returns WRITTEN, or UNCHANGED where it is there, ``resume`` is set and it
    holds the same rows; anything else that is there raises."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("errorifexists").parquet(path)
        return "WRITTEN"
    if not resume:
        raise FileExistsError(path)
    there = spark.read.parquet(path)
    if sorted(there.columns) != sorted(df.columns) or digest(there.select(*df.columns)) != digest(df):
        raise ValueError(f"{path} holds another version")
    return "UNCHANGED"


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and content hash of each partition of a table, in one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sha2(F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).cast("string"), 256).alias("content"))
