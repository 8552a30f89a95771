"""Core tables that keep every version of a row, so that a batch can be undone.

A version is valid from the batch that loaded it to the batch that replaced it. Rows still
valid are in the ``_open=true`` folders, replaced ones beside them under ``_open=false``, by
month, so that reading the present never touches the past. Merging a batch closes the open
rows that share a key with it; undoing batches removes their versions and lets the versions
before them run on to the next batch that is left. Only months that hold such a key are
rewritten, by one write beside the table; the folders are then moved into their places.

Merging a batch that is there already replaces what it loaded before, so a repeated merge
changes nothing. NULL keys count as equal values. Rows that repeat a key within a batch all
stay, and are closed together. A batch without rows, or one that is unknown, changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import month
from ledgerloom.session import join_side, materialize
from ledgerloom.sources.contracts import CONTRACTS
from ledgerloom.sources.tables import MONTH, drop_path, exists

OPEN, FROM, TO = "_open", "valid_from_batch", "valid_to_batch"


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; a key with NULLs in it is a key."""
    return df.select(F.struct(*keys).alias("_key")).distinct()


def _of(keys: list[str]) -> Column:
    return F.struct(*keys).alias("_key")


def _month_of(df: DataFrame, table: str) -> Column:
    event = CONTRACTS[table].event_date
    day = F.col(event)
    stamp = month(day) if dict(df.dtypes)[event] in ("date", "timestamp", "timestamp_ntz") else day
    return F.coalesce(stamp, F.lit("none"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Every version, with its batches, its month and whether it is open."""
    return spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string")).withColumn(OPEN, F.col(OPEN).cast("boolean"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows valid now; the closed folders are not read."""
    return versions(spark, path).filter(F.col(OPEN)).drop(OPEN, MONTH, FROM, TO)


def as_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The rows valid after ``batch_id`` was merged."""
    then = (F.col(FROM) <= batch_id) & (F.col(TO).isNull() | (F.col(TO) > batch_id))
    return versions(spark, path).filter(then).drop(OPEN, MONTH, FROM, TO)


def chained(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each version closed by the next batch that holds its key.

    The window runs over the distinct batches of a key, which are few, not over its rows.
    """
    steps = df.select(_of(keys), FROM).distinct()
    steps = steps.withColumn(TO, F.lead(FROM).over(Window.partitionBy("_key").orderBy(FROM)))
    out = df.drop(TO, OPEN).withColumn("_key", F.struct(*keys)).alias("v")
    same = F.col("v._key").eqNullSafe(F.col("s._key")) & (F.col(f"v.{FROM}") == F.col(f"s.{FROM}"))
    # As many as the keys, so never sent to every task by the size of a compressed file.
    return out.join(steps.hint("merge").alias("s"), same).select("v.*", f"s.{TO}").drop("_key").withColumn(OPEN, F.col(TO).isNull())


def _replace(rows: DataFrame, path: str, touched: set[tuple[bool, str]]) -> None:
    """Put the folders of ``rows`` in the place of those there; of ``touched`` folders those left without rows go.

    ``rows`` may read the folders they replace, so they are written beside them, once, where readers do
    not look, and moved when all are there.
    """
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    aside = f"{path}/.next-{uuid.uuid4().hex}"
    rows.hint("rebalance", OPEN, MONTH).write.partitionBy(OPEN, MONTH).parquet(aside)
    files = jvm.org.apache.hadoop.fs.Path(aside).getFileSystem(conf)

    def under(folder: str) -> list[str]:
        return [f.getPath().getName() for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.isDirectory()]

    made = {(kind, stamp) for kind in under(aside) for stamp in under(f"{aside}/{kind}")}
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for kind, stamp in made | {(f"{OPEN}={str(o).lower()}", f"{MONTH}={name(m)}") for o, m in touched}:
        drop_path(rows.sparkSession, f"{path}/{kind}/{stamp}")
    for kind, stamp in made:
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}"))
        if not files.rename(jvm.org.apache.hadoop.fs.Path(f"{aside}/{kind}/{stamp}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{stamp}")):
            raise OSError(f"{aside}/{kind}/{stamp} could not be moved to its place")
    drop_path(rows.sparkSession, aside)


def load_versions(rows: DataFrame, table: str, path: str, batch: str = "load_batch_id") -> DataFrame:
    """Write the versions of many batches at once: as if merged one after the other."""
    keys = list(CONTRACTS[table].key)
    staged = rows.withColumn(FROM, F.col(batch).cast("bigint")).withColumn(MONTH, _month_of(rows, table))
    chained(staged, keys).hint("rebalance", OPEN, MONTH).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(OPEN, MONTH).parquet(path)
    return versions(rows.sparkSession, path)


def merge_batch(staging: DataFrame, table: str, path: str, batch_id: int) -> DataFrame:
    """Upsert one batch by business key; what it replaces is kept as closed versions."""
    spark, keys = staging.sparkSession, list(CONTRACTS[table].key)
    staged = staging.withColumn("load_batch_id", F.lit(batch_id).cast("bigint"))
    staged = staged.withColumns({FROM: F.lit(batch_id).cast("bigint"), TO: F.lit(None).cast("bigint"), OPEN: F.lit(True), MONTH: _month_of(staged, table)})
    if not exists(spark, path):
        staged.hint("rebalance", MONTH).write.partitionBy(OPEN, MONTH).parquet(path)
        return current(spark, path)
    before = versions(spark, path)
    if not before.filter(F.col(FROM) == batch_id).isEmpty():
        undo_batches(spark, table, path, [batch_id])
        before = versions(spark, path)
    staged = materialize(staged, f"batch-{table}")
    wanted = join_side(_keyed(staged, keys), f"batch-keys-{table}")
    hit = before.filter(F.col(OPEN)).select(_of(keys), MONTH).join(wanted, "_key", "left_semi").select(MONTH).distinct()
    # One value per month of history: small however many rows there are.
    old_months = [r[0] for r in hit.collect()]
    new_months = sorted({*old_months, *(r[0] for r in staged.select(MONTH).distinct().collect())})
    is_open = before.filter(F.col(OPEN) & F.col(MONTH).isin(new_months)).withColumn("_key", F.struct(*keys))
    # One pass tells the rows that close from those that stay.
    marked = is_open.join(wanted.withColumn("_hit", F.lit(True)), "_key", "left").withColumns({
        TO: F.when(F.col("_hit"), F.lit(batch_id).cast("bigint")).otherwise(F.col(TO)), OPEN: F.col("_hit").isNull()}).drop("_key", "_hit")
    past = before.filter(~F.col(OPEN) & F.col(MONTH).isin(old_months))
    merged = staged.unionByName(marked, allowMissingColumns=True).unionByName(past, allowMissingColumns=True)
    _replace(merged, path, {(True, m) for m in new_months})
    return current(spark, path)


def undo_batches(spark: SparkSession, table: str, path: str, gone: Iterable[int]) -> DataFrame:
    """Remove the versions of some batches; what they had replaced is valid again."""
    keys, gone = list(CONTRACTS[table].key), sorted(set(gone))
    before = versions(spark, path)
    leaving = before.filter(F.col(FROM).isin(gone))
    touched_keys = join_side(_keyed(leaving, keys), f"undo-keys-{table}")
    marked = before.withColumn("_key", F.struct(*keys))
    places = marked.select("_key", OPEN, MONTH).join(touched_keys, "_key", "left_semi").select(OPEN, MONTH).distinct().collect()
    if not places:
        return current(spark, path)
    stamps = sorted({r[MONTH] for r in places})
    # A version that is opened again moves to the open folder of its own month.
    there = marked.filter(F.col(MONTH).isin(stamps))
    touched = there.join(touched_keys, "_key", "left_semi").drop("_key").filter(~F.col(FROM).isin(gone))
    rest = there.join(touched_keys, "_key", "left_anti").drop("_key")
    # Written, as the chain reads them twice.
    _replace(rest.unionByName(chained(materialize(touched, f"undo-{table}"), keys)), path, {(o, m) for o in (True, False) for m in stamps})
    return current(spark, path)


# ---- the batch log ------------------------------------------------------
LOG_SCHEMA = "batch_id long, status string, logged_at timestamp"


def log_batch(spark: SparkSession, path: str, batch_ids: Iterable[int], status: str, at: dt.datetime) -> None:
    """Append one entry per batch; the newest entry is a batch's status."""
    spark.createDataFrame([(b, status, at) for b in batch_ids], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def batch_status(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    return log.groupBy("batch_id").agg(F.max(F.struct("logged_at", "status")).alias("_last")).select("batch_id", "_last.status", "_last.logged_at")
