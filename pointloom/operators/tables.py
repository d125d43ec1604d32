"""Tables written on the way: they end a plan's lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a temporary one where it is unset (tests). A
    cluster's executors do not share the driver's temporary folders: there the setting is required."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='pointloom-')}")
        at = _own[0]
    return at.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def let_go(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what came out of them has been written, or collected. Frames
    that were not returned by `written` stay as they are."""
    for t in tables:
        path = t.__dict__.pop("written_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a bucket.
BUCKET = 500_000


@contextmanager
def bucketed(df: DataFrame, by: str, name: str = "table") -> Iterator[DataFrame]:
    """df as a table in buckets of a column, as many as its rows ask for: rounds that join it by that column read it where
    it lies, and a task sorts one bucket. The table is gone afterwards, so what came out of it must have been written."""
    spark = df.sparkSession
    held = written(df, name)
    buckets = max(1, -(-held.count() // BUCKET))
    found = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{found}"
    held.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).option("compression", "zstd").saveAsTable(found)
    let_go(held)
    table = spark.table(found)
    table.written_at = path
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE {found}")
        let_go(table)


class Growing:
    """A table that rounds add to: one folder, so that its plan does not grow with the rounds."""

    def __init__(self, first: DataFrame, name: str = "growing"):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.add(first)

    def add(self, more: DataFrame) -> None:
        more.write.mode("append").option("compression", "zstd").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
