"""Writing marts and merging core tables kept as month-partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.exprs import month
from ledgerloom.operators.ingest import upsert
from ledgerloom.session import materialize
from ledgerloom.sources.contracts import CONTRACTS

MONTH = "_month"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order; a missing or differently typed one is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if have.get(f.name) != f.dataType:
            raise TypeError(f"column {f.name}: expected {f.dataType.simpleString()}, got {have.get(f.name)}")
    return df.select(*schema.fieldNames())


def write_mart(df: DataFrame, path: str, partition: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Full refresh; an empty frame leaves an empty table.

    Rows are rebalanced before the write, so a heavy period becomes several
    files of even size and light ones are put together.
    """
    if schema is not None:
        df = conform(df, schema)
    writer = (df.hint("rebalance", partition) if partition else df.hint("rebalance")).write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    writer.option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_monthly(df: DataFrame, path: str, stamp: Column) -> T.StructType:
    """Full refresh in one folder per month of ``stamp`` (``YYYY-MM``); the schema to read it with."""
    dated = df.withColumn(MONTH, F.coalesce(stamp, F.lit("none")))
    dated.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(MONTH).parquet(path)
    return dated.schema


def read_months(spark: SparkSession, path: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame:
    """A monthly table, or only the folders of some months."""
    df = spark.read.schema(schema).parquet(path)
    return (df if months is None else df.filter(F.col(MONTH).isin(months))).drop(MONTH)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def merge_into(staging: DataFrame, table: str, path: str) -> DataFrame:
    """Upsert staged rows by business key, rewriting only the months they touch.

    A row whose date moved touches its old month too. The merged months are
    written aside before any file in use is replaced.
    """
    spark, contract = staging.sparkSession, CONTRACTS[table]
    kind = dict(staging.dtypes)[contract.event_date]
    day = F.col(contract.event_date)
    stamp = month(day) if kind == "date" else day
    staged = staging.withColumn(MONTH, F.coalesce(stamp, F.lit("none")))
    keys = list(contract.key)
    if not exists(spark, path):
        staged.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(path)
        return spark.read.schema(staged.schema).parquet(path)

    target = spark.read.schema(staged.schema).parquet(path)
    hit = target.join(staged.select(*keys).distinct(), keys, "left_semi").select(MONTH)
    # One value per month of history: small however many rows there are.
    months = [r[0] for r in hit.union(staged.select(MONTH)).distinct().collect()]
    before = target.filter(F.col(MONTH).isin(months))
    merged = materialize(upsert(before, staged, keys), f"merge-{table}")
    merged.hint("rebalance", MONTH).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    left = {r[0] for r in merged.select(MONTH).distinct().collect()}
    for gone in set(months) - left:
        drop_path(spark, f"{path}/{MONTH}={gone}")
    return spark.read.schema(staged.schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
