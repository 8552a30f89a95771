"""Upload and file-log tables derived from the raw parquet tables.

They carry the dirt the checks look for: bad numbers and dates, negative
quantities, repeated keys, blank lots, periods that do not fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, table
from ledgerloom.functions.exprs import month
from ledgerloom.operators.ingest import PROMOTIONS

RAW_HEADERS = {
    "출고번호": "shipment_id", "출고일": "ship_date", "창고": "warehouse_id", "SKU": "item_id", "lot_id": "lot_id",
    "출고수량": "qty_shipped", "중량": "weight", "order_id": "channel_order_id",
}


@table("raw_shipments")
def raw_shipments(cat: Catalog) -> DataFrame:
    """Shipment file rows as text under the sender's own headers."""
    k = F.col("item_id").cast("int")
    qty = F.when(k % 50 == 0, "n/a").when(k % 53 == 0, "-3").otherwise(F.col("qty_shipped").cast("string"))
    day = F.when(k % 41 == 0, "soon").when(k % 61 == 0, "2010-01-01").when(k % 67 == 0, "1985-05-05").when(
        k % 3 == 0, F.date_format("ship_date", "yyyy/MM/dd")).otherwise(F.col("ship_date").cast("string"))
    return cat["fact_shipment"].select(
        "shipment_id", day.alias("ship_date"), "warehouse_id", "item_id",
        F.when(k % 7 != 0, F.col("lot_id")).alias("lot_id"), qty.alias("qty_shipped"),
        F.col("weight").cast("string").alias("weight"), "channel_order_id", F.lit("memo").alias("memo"),
    ).withColumnsRenamed({v: h for h, v in RAW_HEADERS.items()})


@table("raw_charges")
def raw_charges(cat: Catalog) -> DataFrame:
    odd = (F.substring("period", 6, 2) == "07") & (F.col("invoice_line_no") == 5)
    return cat["fact_charge_actual"].withColumn(
        "charge_type", F.when(odd, "MYSTERY_FEE").otherwise(F.col("charge_type")))


@table("raw_upload_text")
def raw_upload_text(cat: Catalog) -> DataFrame:
    """Settlement rows as a browser would read them from a sheet."""
    k = F.col("line_no") % 10
    return cat["fact_settlement"].select(
        F.concat(F.lit(" "), "settlement_id").alias("settlement_id"),
        F.col("line_no").cast("string").alias("line_no"),
        F.when(k == 0, F.regexp_replace("period", "-", "")).when(k == 1, F.regexp_replace("period", "-", "/"))
        .otherwise(F.col("period")).alias("period"),
        F.when(k == 2, "  ").otherwise(F.col("channel_store_id")).alias("channel_store_id"),
        F.when(k == 3, "").otherwise(F.col("currency")).alias("currency"),
        F.when(k == 4, "oops").otherwise(
            F.concat(F.lit("1,"), F.lpad((F.col("line_no") % 1000).cast("string"), 3, "0"))).alias("gross_sales"),
        F.when(k == 5, "Y").when(k == 6, "no").when(k == 7, "").otherwise("true").alias("accrual_flag"))


@table("upload_shipment")
def upload_shipment(cat: Catalog) -> DataFrame:
    """Every line version as an upload; batches repeat keys."""
    part = F.col("l_partkey")
    day = F.col("l_shipdate").cast("date")
    return cat.source("lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_suppkey").alias("batch_id"),
        ((part * 100 + F.col("l_quantity").cast("bigint")) * 10000
         + F.datediff(day, F.lit("1990-01-01").cast("date"))).alias("raw_id"),
        F.concat(F.lit("ship_"), F.col("l_suppkey"), F.lit(".csv")).alias("source_file_name"),
        F.concat(F.lit("SH"), F.col("l_orderkey")).alias("shipment_id"),
        (part % 5).cast("string").alias("item_id"),
        F.when(part % 3 == 0, "").otherwise(F.concat(F.lit("L"), part % 3)).alias("lot_id"),
        day.alias("ship_date"),
        F.concat(F.lit("W"), F.col("l_suppkey") % 5).alias("warehouse_id"),
        F.when(part % 97 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty_shipped"),
        (F.col("l_quantity") * 0.5).alias("weight"),
        F.col("l_orderkey").cast("string").alias("channel_order_id"),
        F.when(part % 2 == 0, "WMS").alias("source_system"),
        F.when(part % 13 == 0, F.date_add(day, 2)).otherwise(day).alias("promised_ship_date"),
        F.when(part % 17 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 3)).alias("delivered_at"))


@table("upload_inventory_snapshot")
def upload_inventory_snapshot(cat: Catalog) -> DataFrame:
    k = F.col("item_id").cast("int") % 10
    copies = F.when(k == 7, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    day = F.datediff("snapshot_date", F.lit("1998-01-01").cast("date"))
    df = cat["fact_inventory_snapshot"].withColumn("_copy", F.explode(copies))
    return df.select(
        F.concat("warehouse_id", F.lit(".csv")).alias("source_file_name"),
        (((F.col("item_id").cast("bigint") * 3 + F.substring("lot_id", 2, 1).cast("int")) * 60 + day) * 2
         + F.col("_copy")).alias("source_row_no"),
        "snapshot_date", "warehouse_id", "item_id", F.when(k != 3, F.col("lot_id")).alias("lot_id"),
        F.when(k == 5, -F.col("onhand_qty")).otherwise(F.col("onhand_qty")).alias("onhand_qty"),
        (F.col("onhand_qty") + k - 8).alias("sellable_qty"),
        F.when(k == 1, F.col("onhand_qty") + 1).otherwise(F.lit(1.0)).alias("blocked_qty"),
        F.when(k == 2, F.lit(None).cast("double")).otherwise(F.lit(2.0)).alias("reserved_qty"))


@table("upload_purchase_order")
def upload_purchase_order(cat: Catalog) -> DataFrame:
    k = F.col("item_id").cast("int") % 10
    return cat["fact_po"].select(
        F.concat("supplier_id", F.lit(".csv")).alias("source_file_name"), "po_id", "item_id", "po_date",
        F.when(k == 0, F.date_sub("po_date", 1)).otherwise(F.col("eta_date")).alias("eta_date"), "qty_ordered")


@table("upload_receipt")
def upload_receipt(cat: Catalog) -> DataFrame:
    k = F.col("item_id").cast("int") % 10
    return cat["fact_receipt"].select(
        F.concat("warehouse_id", F.lit(".csv")).alias("source_file_name"), "receipt_id", "item_id", "receipt_date",
        F.when(k == 0, F.date_add("receipt_date", 3)).otherwise(F.date_sub("receipt_date", 60)).alias("mfg_date"),
        F.when(k == 1, F.date_sub("receipt_date", 90)).otherwise(F.date_add("receipt_date", 300)).alias("expiry_date"))


@table("upload_sales")
def upload_sales(cat: Catalog) -> DataFrame:
    k = F.col("line_no") % 10
    first = F.concat("period", F.lit("-01")).cast("date")
    return cat["fact_settlement"].select(
        F.concat("settlement_id", F.lit(".csv")).alias("source_file_name"), "settlement_id", "line_no", "period",
        F.when(k == 0, F.add_months(first, -1)).otherwise(first).alias("order_date"),
        F.when(k == 1, F.add_months(first, 1)).when(k == 2, F.lit(None).cast("date")).otherwise(first).alias("ship_date"))


@table("upload_charge")
def upload_charge(cat: Catalog) -> DataFrame:
    no = F.col("invoice_line_no")
    return cat["fact_charge_actual"].select(
        F.concat("invoice_no", F.lit(".csv")).alias("source_file_name"), "invoice_no", "invoice_line_no", "charge_type",
        "period", F.when(no == 2, F.date_add("invoice_date", 1)).otherwise(F.col("invoice_date")).alias("invoice_date"),
        F.when(no == 3, month(F.date_add("invoice_date", 1))).otherwise(F.col("period")).alias("reference_period"))


@table("file_log")
def file_log(cat: Catalog) -> DataFrame:
    """One logged file per customer that ordered."""
    key = F.col("o_custkey")
    kind = key % 7
    return cat.source("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("o_orderdate").cast("date").alias("processed_on"),
    ).select(
        (key % 50).alias("batch_id"), F.concat(F.lit("orders_"), key, F.lit(".csv")).alias("file_name"),
        F.sha2(key.cast("string"), 256).alias("file_hash"), F.lit("fact_order").alias("table_name"), "row_count",
        F.when(kind == 0, "dq_failed").when(kind == 1, "duplicate").when(kind == 2, "skipped").otherwise("success")
        .alias("status"), "processed_on")


@table("batch_log")
def batch_log(cat: Catalog) -> DataFrame:
    return cat["file_log"].groupBy("batch_id").agg(
        F.min("processed_on").alias("started_on"), F.max("processed_on").alias("finished_on"),
        F.count(F.lit(1)).alias("file_count"), F.sum("row_count").alias("rows_ingested"),
    ).withColumn("batch_status", F.when(F.col("batch_id") % 9 == 0, "failed").otherwise("success"))


#: The measure that a second upload corrects, by core table.
CORRECTED = {
    "fact_inventory_snapshot": "onhand_qty", "fact_po": "qty_ordered", "fact_receipt": "qty_received", "fact_shipment": "qty_shipped",
    "fact_return": "qty_returned", "fact_settlement": "net_payout", "fact_charge_actual": "amount",
}


def dataset_upload(cat: Catalog, dataset: str) -> DataFrame:
    """One dataset as its senders would upload it: every row, and a correction of about a third of the keys.

    One correction in five lowers the measure below zero.
    """
    promotion = PROMOTIONS[dataset]
    value = CORRECTED[promotion["core"]]
    digit = F.substring(F.md5(F.col(promotion["key"][0]).cast("string")), 1, 1)
    rows = cat[promotion["core"]].withColumn("raw_id", F.xxhash64(*promotion["key"])).withColumn("_digit", digit)
    # Each row is made once and repeated, so what is behind the core table runs once.
    one, two = (F.lit(n).cast("bigint") for n in (1, 2))
    both = rows.withColumn("batch_id", F.explode(F.when(F.col("_digit") < "5", F.array(one, two)).otherwise(F.array(one))))
    fixed = F.when(F.col("_digit") == "0", F.lit(-1.0)).otherwise(F.col(value) + 1000)
    both = both.withColumn(value, F.when(F.col("batch_id") == 2, fixed).otherwise(F.col(value))).drop("_digit")
    return both.withColumns({"source_file_name": F.lit(f"{dataset}.csv"), "source_row_no": F.col("batch_id")})


@table("upload_return")
def upload_return(cat: Catalog) -> DataFrame:
    return dataset_upload(cat, "return")
