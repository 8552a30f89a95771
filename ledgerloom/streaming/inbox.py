"""File arrival as a stream: each micro-batch goes through the same ingest steps.

A ledger holds what became of each micro-batch, by query id and batch id. A batch is entered
as started, with the load batch id it gets, before anything is written, and as done after its
rows, its reports and its file log are. When a batch is run again, a done one is skipped, and a
started one takes the load batch id it had: its rows merge over themselves, its reports replace
themselves, and files that it had logged are not logged twice. The query id is in the
checkpoint, which therefore has a fixed place beside the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.exprs import month
from ledgerloom.operators import ingest, quality
from ledgerloom.plans.coverage import split_by_gate
from ledgerloom.policy import Policy
from ledgerloom.session import materialize
from ledgerloom.sources import history
from ledgerloom.sources.contracts import CONTRACTS, SYSTEM_COLUMNS
from ledgerloom.sources.files import file_hashes, new_files
from ledgerloom.sources.tables import append_log, exists, merge_into

LEDGER = "query_id string, stream_batch long, load_batch_id long, status string"
#: Where a row stands in its file: the block's start, and an id that grows with the read order.
PLACE = ["_start", "_id"]


def with_place(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with their file and place."""
    return rows.withColumns({"file_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})


def numbered(rows: DataFrame) -> DataFrame:
    """``row_no`` from 1 within each file, from the places; only block sizes are put in order.

    ``rows`` must be written already, so that ids are the same on every read.
    """
    blocks = rows.groupBy("file_path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file_path", "_start", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, ["file_path", "_start"]).withColumn("row_no", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_before", "_first", *PLACE)


def load_rows(
    rows: DataFrame, table: str, path: str, log_path: str, batch_id: int, policy: Policy,
    hashes: DataFrame, closed: DataFrame | None = None, versioned: bool = False,
) -> None:
    """Check, cast, gate and merge one batch of raw string rows.

    ``rows`` carries ``file_path`` and the places; ``hashes`` gives each path its content
    hash. A file with a failed CRITICAL or HIGH check loads nothing; warnings are logged and
    load. Rows of a closed period are held back. Files merge as if taken in path order. The
    reports go to ``<log_path>_dq``. ``versioned`` keeps what is replaced, for a rollback.
    """
    spark, contract = rows.sparkSession, CONTRACTS[table]
    written = materialize(rows.join(hashes, "file_path"), f"inbox-{table}")
    named = ingest.apply_aliases(numbered(written), table)
    report = materialize(quality.report_by_file(named, table, policy, "file_path", "row_no"), f"report-{table}")
    gate = quality.gate(report, ["file_path"])
    hard = gate.filter("rejected").select("file_path")
    clean = named.join(hard, "file_path", "left_anti").withColumnRenamed("file_hash", "source_file_hash")
    known = [c for c in clean.columns if c in contract.columns or c in SYSTEM_COLUMNS]
    kept = ingest.cast_columns(clean.select(*known, "file_path"), table)
    staged = ingest.add_system_columns(kept, table, batch_id, F.col("source_file_hash"), policy.as_of)
    for c in contract.columns:
        if c not in staged.columns:
            staged = staged.withColumn(c, F.lit(None).cast(contract.spark_type(c)))
    staged = ingest.latest_per_key(staged, list(contract.key), [F.desc("file_path")]).drop("file_path")
    if closed is not None:
        event = F.col(contract.event_date)
        stamp = month(event) if contract.columns[contract.event_date] == "DATE" else event
        staged = split_by_gate(staged.withColumn("_p", stamp), closed, "_p")[0].drop("_p")
    if versioned:
        history.merge_batch(staged, table, path, batch_id)
    else:
        merge_into(staged, table, path)
    # By batch, so that a batch run again replaces its report.
    report.withColumns({"table_name": F.lit(table), "batch_id": F.lit(batch_id).cast("bigint")}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{log_path}_dq")
    _log_files(named.groupBy("file_path", "file_hash").agg(F.count(F.lit(1)).alias("row_count")).join(
        gate, "file_path", "left").select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "file_path", "file_hash",
        F.lit(table).alias("table_name"), "row_count",
        F.when(F.col("rejected"), "dq_failed").otherwise("success").alias("status")), log_path)


def _log_files(files: DataFrame, log_path: str) -> None:
    """Append to the file log what it does not have yet."""
    if exists(files.sparkSession, log_path):
        known = files.sparkSession.read.parquet(log_path).select("batch_id", "file_path")
        files = materialize(files.join(known, ["batch_id", "file_path"], "left_anti").select(*files.columns), "file-log")
    append_log(files, log_path)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def _enter(spark: SparkSession, path: str, *row: object) -> None:
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(path)


def once(spark: SparkSession, path: str, query_id: str, stream_batch: int, load) -> bool:
    """Call ``load(load_batch_id)`` unless the ledger has the batch as done; whether it was called."""
    ledger = _ledger(spark, path)
    entries = {r.status: r.load_batch_id for r in ledger.filter((F.col("query_id") == query_id) & (F.col("stream_batch") == stream_batch)).collect()}
    if "done" in entries:
        return False
    given = entries.get("started")
    if given is None:
        given = 1 + (ledger.agg(F.max("load_batch_id")).first()[0] or 0)
        _enter(spark, path, query_id, stream_batch, given, "started")
    load(given)
    _enter(spark, path, query_id, stream_batch, given, "done")
    return True


def inbox_stream(
    spark: SparkSession, folder: str, headers: list[str], table: str, path: str, log_path: str,
    policy: Policy | None = None, closed: DataFrame | None = None, checkpoint: str | None = None, versioned: bool = False,
    max_files: int | None = None,
) -> StreamingQuery:
    """Process every CSV waiting in ``folder`` and stop; run again for later files.

    Files already seen are remembered in the checkpoint, ``<log_path>_checkpoint`` unless
    given. ``max_files`` bounds a micro-batch.
    """
    policy = policy or Policy()
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    reader = spark.readStream.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    source = reader.csv(folder)
    rows = source.withColumns({"file_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})

    def each(batch: DataFrame, batch_id: int) -> None:
        def load(load_batch_id: int) -> None:
            placed = batch.withColumn("_id", F.monotonically_increasing_id())
            # One entry per file of the micro-batch, which the source options bound.
            paths = [r[0] for r in batch.select("file_path").distinct().collect()]
            if not paths:
                return
            hashes = file_hashes(spark, paths).select(F.col("path").alias("file_path"), "file_hash")
            hashes = materialize(hashes, "inbox-hashes")
            # What this batch logged before it was stopped is loaded again, over itself.
            fresh = new_files(hashes, spark.read.parquet(log_path).filter(F.col("batch_id") != load_batch_id)) if exists(spark, log_path) else hashes
            # Of files with the same content the first path counts.
            first = fresh.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
            fresh = materialize(fresh.join(first, ["file_hash", "file_path"], "left_semi"), "inbox-fresh")
            load_rows(placed, table, path, log_path, load_batch_id, policy, fresh, closed, versioned)
            _log_files(hashes.join(fresh, "file_path", "left_anti").select(
                F.lit(load_batch_id).cast("bigint").alias("batch_id"), "file_path", "file_hash", F.lit(table).alias("table_name"),
                F.lit(0).cast("bigint").alias("row_count"), F.lit("skipped").alias("status")), log_path)

        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        once(spark, f"{log_path}_ledger", query_id, batch_id, load)

    return rows.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint or f"{log_path}_checkpoint").trigger(availableNow=True).start()
