"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import session
from ledgerloom.session import release


def discard(*tables: DataFrame) -> None:
    """Remove the files of written tables that no frame still to be worked out reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Chain:
    """Tables that replace one another: writing the next one removes the one before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.last = spark, ""

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = session.scratch_dir(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        release(self.spark)
        if self.last:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.last)
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder, with the writer's ``options``, and read it back."""
    if not options:
        out = session.materialize(df, label)
    else:
        path = session.scratch_dir(df.sparkSession, label)
        df.write.options(**options).parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    release(df.sparkSession)
    return out
