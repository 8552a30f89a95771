"""Files to core rows: scans, casts, merges, logs and status reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import exact_sum
from ledgerloom.operators import ingest
from ledgerloom.session import scratch_dir
from ledgerloom.sources import files, uploadlog
from ledgerloom.sources.canonical import share_lines
from ledgerloom.sources.tables import drop_path
from ledgerloom.sources.uploads import CORRECTED, dataset_upload
from ledgerloom.streaming.inbox import inbox_stream

LOADED_ON = dt.date(2002, 1, 1)


# ---- file scans ---------------------------------------------------------
def _write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def _inbox(cat: Catalog) -> str:
    """An inbox with shipment, order and purchase-order files written from the tables."""
    root = scratch_dir(cat.spark, "inbox")
    _write_csv(cat["raw_shipments"], f"{root}/shipments")
    orders = cat["fact_order"].select(
        F.col("source_system").alias("system"), F.col("channel_order_id").alias("주문번호"),
        F.col("line_no").alias("라인"), F.col("order_date").alias("주문일"), F.col("channel_store_id").alias("스토어ID"),
        F.col("item_id").alias("상품코드"), F.col("qty_ordered").alias("주문수량"))
    _write_csv(orders, f"{root}/orders")
    _write_csv(cat["fact_po"], f"{root}/purchases")
    _write_csv(cat["daily_events"], f"{root}/other")
    return root


@query("read_csv_strings")
def read_csv_strings(cat: Catalog) -> DataFrame:
    path = scratch_dir(cat.spark, "csv")
    _write_csv(cat["fact_shipment"].select("shipment_id", "ship_date", "warehouse_id", "qty_shipped", "weight"), path)
    return files.read_csv_strings(cat.spark, path)


@query("inbox_scan")
def inbox_scan(cat: Catalog) -> DataFrame:
    """Data rows behind each distinct header of the inbox."""
    return files.inbox_scan(cat.spark, _inbox(cat)).groupBy("header").agg(F.sum("rows").alias("rows"))


@query("file_dedup")
def file_dedup(cat: Catalog) -> DataFrame:
    """Rows left to load when the order files were already loaded with success."""
    root = _inbox(cat)
    hashes = files.file_hashes(cat.spark, root)
    seen = hashes.withColumn("status", F.when(F.col("path").contains("/orders/"), "success").otherwise("dq_failed"))
    fresh = files.new_files(hashes, seen).select(F.col("path").alias("file_path"))
    scanned = files.inbox_scan(cat.spark, root)
    return scanned.join(fresh, "file_path", "left_semi").groupBy("header").agg(F.sum("rows").alias("rows"))


ORDER_HEADERS = ["system", "주문번호", "라인", "주문일", "스토어ID", "상품코드", "주문수량"]


@query("inbox_stream")
def inbox_stream_rows(cat: Catalog) -> DataFrame:
    """The order files streamed in, with the last micro-batch run a second time: the rows of one batch ingest."""
    root, out = _inbox(cat), scratch_dir(cat.spark, "streamed")

    def run() -> int:
        stream = inbox_stream(cat.spark, f"{root}/orders", ORDER_HEADERS, "fact_order", f"{out}/fact_order", f"{out}/log", cat.policy)
        stream.awaitTermination()
        return cat.spark.read.parquet(f"{out}/log_ledger").agg(F.max("stream_batch")).first()[0]

    # Without its commit a micro-batch is run again on the next start.
    drop_path(cat.spark, f"{out}/log_checkpoint/commits/{run()}")
    run()
    return cat.spark.read.parquet(f"{out}/fact_order").select(
        "source_system", "channel_order_id", "line_no", "order_date", "channel_store_id", "item_id", "qty_ordered", "load_batch_id")


def _detected(cat: Catalog, **options: object) -> DataFrame:
    scanned = files.inbox_scan(cat.spark, _inbox(cat))
    return scanned.join(files.detect_table(scanned, **options), "file_path").groupBy(
        "header", "table_name", "score", "verdict").agg(F.sum("rows").alias("rows"))


@query("detect_table")
def detect_table(cat: Catalog) -> DataFrame:
    return _detected(cat)


@query("detect_table_upload")
def detect_table_upload(cat: Catalog) -> DataFrame:
    return _detected(cat, with_key=True, minimum=0.4, tie_fails=False)


# ---- rows ---------------------------------------------------------------
@query("apply_aliases")
def apply_aliases(cat: Catalog) -> DataFrame:
    return ingest.apply_aliases(cat["raw_shipments"], "fact_shipment")


@query("filter_columns")
def filter_columns(cat: Catalog) -> DataFrame:
    return ingest.filter_columns(cat["apply_aliases"], "fact_shipment")


@query("cast_columns")
def cast_columns(cat: Catalog) -> DataFrame:
    return ingest.cast_columns(cat["filter_columns"], "fact_shipment")


@query("add_system_columns")
def add_system_columns(cat: Catalog) -> DataFrame:
    return ingest.add_system_columns(
        cat["cast_columns"], "fact_shipment", 42, F.sha2(F.lit("inbox.csv"), 256), LOADED_ON)


@query("parse_upload_values")
def parse_upload_values(cat: Catalog) -> DataFrame:
    return ingest.parse_upload_values(cat["raw_upload_text"], ["line_no", "gross_sales"], ["accrual_flag"])


@query("reject_missing_required")
def reject_missing_required(cat: Catalog) -> DataFrame:
    """Rows turned away, with the columns they lack."""
    need = ["settlement_id", "line_no", "period", "channel_store_id", "currency"]
    return ingest.missing_required(cat["parse_upload_values"], need).filter("missing <> ''").select(
        F.col("line_no").cast("bigint").alias("source_row_no"), "missing")


@query("upload_content_hash")
def upload_content_hash(cat: Catalog) -> DataFrame:
    """Verdicts on four batches: the shipment files; every third again under another name; those forced; those as returns."""
    rows = cat["upload_shipment"].withColumn("row_no", F.lit(1))
    again = rows.filter("batch_id % 3 = 0").withColumn("source_file_name", F.concat(F.lit("copy_of_"), "source_file_name"))
    path = scratch_dir(cat.spark, "upload-log")

    def upload(batch: int, sent: DataFrame, table_name: str, force: bool = False) -> DataFrame:
        hashes = ingest.content_hash(sent, ["source_file_name"], ["batch_id", "raw_id", "row_no"], table_name)
        return uploadlog.admit(hashes.withColumn("table_name", F.lit(table_name)), path, batch, force)

    upload(1, rows, "upload_shipment")
    upload(2, again, "upload_shipment")
    upload(3, again, "upload_shipment", force=True)
    upload(4, again, "upload_return")
    return uploadlog.read_log(cat.spark, path).drop("content_hash")


# ---- merges -------------------------------------------------------------
SHIPMENT_KEY = ["shipment_id", "item_id", "lot_id"]


@query("promote_latest")
def promote_latest(cat: Catalog) -> DataFrame:
    return ingest.promote(cat["upload_shipment"], "shipment").drop("volume_cbm", "channel_store_id")


@query("promote_datasets")
def promote_datasets(cat: Catalog) -> DataFrame:
    """All seven datasets promoted: rows, the sum of the corrected measure, and rows that come from the correction."""
    out = None
    share_lines(cat)
    for dataset, promotion in ingest.PROMOTIONS.items():
        core = ingest.promote(dataset_upload(cat, dataset), dataset)
        one = core.agg(F.count(F.lit(1)).alias("row_count"), exact_sum(CORRECTED[promotion["core"]]).alias("total"),
                       F.count_if(F.col("load_batch_id") == 2).alias("corrected")).withColumn("dataset", F.lit(dataset))
        out = one if out is None else out.unionByName(one)
    return out


@query("upsert_core")
def upsert_core(cat: Catalog) -> DataFrame:
    """Late batches merged over early ones."""
    half = "batch_id % 2"
    early = ingest.promote(cat["upload_shipment"].filter(f"{half} = 0"), "shipment")
    late = ingest.promote(cat["upload_shipment"].filter(f"{half} = 1"), "shipment")
    return ingest.upsert(early, late, SHIPMENT_KEY).drop("volume_cbm", "channel_store_id")


def last_batches(batch_log: DataFrame, n: int) -> DataFrame:
    return batch_log.select("batch_id").orderBy(F.desc("batch_id")).limit(n)


@query("rollback_batch_log")
def rollback_batch_log(cat: Catalog) -> DataFrame:
    gone = last_batches(cat["batch_log"], 3).withColumn("_gone", F.lit(True))
    return cat["batch_log"].join(gone, "batch_id", "left").withColumn(
        "batch_status", F.when(F.col("_gone"), "rolled_back").otherwise(F.col("batch_status"))).drop("_gone")


# ---- logs and status ----------------------------------------------------
@query("charge_policy_dim")
def charge_policy_dim(cat: Catalog) -> DataFrame:
    """Every charge type of the policy with all its attributes, and how many lines were invoiced under it."""
    used = cat["fact_charge_actual"].groupBy("charge_type").agg(F.count(F.lit(1)).alias("_n"))
    return cat.policy.charge_policy(cat.spark).join(used, "charge_type", "left").withColumn("lines", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")


def upload_history_rows(
    cat: Catalog, status: str | None = None, table_name: str | None = None, date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    df = cat["file_log"]
    if status:
        df = df.filter(F.col("status") == status)
    if table_name:
        df = df.filter(F.col("table_name") == table_name)
    if date_from:
        df = df.filter(F.col("processed_on") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.filter(F.col("processed_on") <= F.lit(date_to).cast("date"))
    return df.join(cat["batch_log"], "batch_id", "left")


@query("upload_history")
def upload_history(cat: Catalog) -> DataFrame:
    """The second page of fifty of the newest successful files, with how many there are in all."""
    rows = upload_history_rows(cat, status="success", table_name="fact_order", date_from="1995-06-01")
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    page = rows.orderBy(F.desc("processed_on"), "file_name").offset(50).limit(50)
    return page.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


@query("upload_status_tally")
def upload_status_tally(cat: Catalog) -> DataFrame:
    return cat["file_log"].groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("rows"))


FACTS = ["fact_order", "fact_shipment", "fact_return", "fact_inventory_snapshot", "fact_po", "fact_receipt",
         "fact_settlement", "fact_charge_actual", "fact_exchange_rate", "fact_cost_structure", "dim_item"]


@query("table_row_counts")
def table_row_counts(cat: Catalog) -> DataFrame:
    out = None
    for name in FACTS:
        one = cat[name].agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("status_summary")
def status_summary(cat: Catalog) -> DataFrame:
    """Last batch, failed checks, locked periods, coverage gaps and issue counts as labelled rows."""
    def rows(df: DataFrame, section: str, label, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), label.cast("string").alias("label"),
                         value.cast("string").alias("value"))

    batch = cat["batch_log"].orderBy(F.desc("batch_id")).limit(1)
    failed = cat["dq_report"].filter("NOT passed").orderBy("check_name").limit(5)
    gaps = cat["mart_coverage_period"].filter("severity <> 'OK'").orderBy("severity", "domain", "period").limit(10)
    issues = cat["constraint_issues"].groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (
        rows(batch, "last_batch", F.col("batch_id"), F.col("batch_status"))
        .unionByName(rows(failed, "failed_check", F.col("check_name"), F.col("severity")))
        .unionByName(rows(cat["closed_periods"], "closed_period", F.col("period"), F.lit("closed")))
        .unionByName(rows(gaps, "coverage_gap", F.concat_ws("/", "domain", "period"), F.col("severity")))
        .unionByName(rows(issues, "issues", F.col("severity"), F.col("n")))
    )
