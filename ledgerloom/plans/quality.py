"""Registered data-quality queries over file rows and upload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import month
from ledgerloom.operators import quality
from ledgerloom.operators.ingest import PROMOTIONS
from ledgerloom.session import materialize
from ledgerloom.sources.canonical import share_lines
from ledgerloom.sources.contracts import CONTRACTS
from ledgerloom.sources.uploads import dataset_upload


@table("shipment_rows")
def shipment_rows(cat: Catalog) -> DataFrame:
    """File rows under canonical names, still text."""
    return cat["apply_aliases"]


@query("dq_required_columns")
def dq_required_columns(cat: Catalog) -> DataFrame:
    """The schema verdict next to the number of rows it decides over."""
    rows = cat["shipment_rows"]
    size = rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("_one", F.lit(1))
    return quality.required_columns(rows, "fact_shipment").withColumn("_one", F.lit(1)).join(size, "_one").drop("_one")


@query("dq_null_keys")
def dq_null_keys(cat: Catalog) -> DataFrame:
    df = cat["shipment_rows"]
    return quality.counted(df, quality.null_keys(df, "fact_shipment"))


@query("dq_duplicate_keys")
def dq_duplicate_keys(cat: Catalog) -> DataFrame:
    uploads = cat["upload_shipment"]
    return quality.duplicate_keys(uploads, "fact_shipment")


@query("dq_type_coercion")
def dq_type_coercion(cat: Catalog) -> DataFrame:
    df = cat["shipment_rows"]
    return quality.counted(df, quality.type_coercion(df, "fact_shipment"))


@query("dq_charge_types")
def dq_charge_types(cat: Catalog) -> DataFrame:
    return quality.charge_types(cat["raw_charges"], cat.policy)


@query("dq_quantity_range")
def dq_quantity_range(cat: Catalog) -> DataFrame:
    """Negative quantities with the first five rows concerned."""
    df = cat["upload_inventory_snapshot"]
    bad = df.filter("onhand_qty < 0")
    total = bad.agg(F.count(F.lit(1)).alias("bad_rows")).withColumn("_one", F.lit(1))
    first = bad.select("source_file_name", "source_row_no").orderBy("source_file_name", "source_row_no").limit(5)
    sample = first.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "source_file_name", "source_row_no"))), ", ").alias("sample")).withColumn("_one", F.lit(1))
    return total.join(sample, "_one").select(
        F.lit("quantity_range_onhand_qty").alias("check_name"), F.lit("HIGH").alias("severity"),
        (F.col("bad_rows") == 0).alias("passed"), "bad_rows", "sample")


@query("dq_amount_outlier")
def dq_amount_outlier(cat: Catalog) -> DataFrame:
    """Settlement amounts in KRW against the outlier limit."""
    krw = cat["mart_pnl_revenue"].select(
        F.col("net_revenue_krw").alias("net_payout"), F.col("gross_sales_krw").alias("gross_sales"))
    return quality.counted(krw, quality.amount_outlier(krw, cat.policy))


@query("dq_date_range")
def dq_date_range(cat: Catalog) -> DataFrame:
    df = cat["shipment_rows"]
    return quality.counted(df, quality.date_range(df, "fact_shipment", cat.policy))


@query("dq_period_continuity")
def dq_period_continuity(cat: Catalog) -> DataFrame:
    return quality.period_continuity(cat["fact_exchange_rate"].filter("currency = 'EUR'"))


@query("dq_cross_ship_vs_inventory")
def dq_cross_ship_vs_inventory(cat: Catalog) -> DataFrame:
    return quality.total_exceeds(
        cat["fact_shipment"], "qty_shipped", cat["fact_inventory_snapshot"], "onhand_qty", "cross_shipment_vs_inventory")


@query("dq_cross_return_vs_ship")
def dq_cross_return_vs_ship(cat: Catalog) -> DataFrame:
    return quality.total_exceeds(
        cat["fact_return"], "qty_returned", cat["fact_shipment"], "qty_shipped", "cross_return_vs_shipment")


def _digits(c: str) -> Column:
    """The digits of a text as one number: every other character of it is taken out."""
    return F.expr(f"translate({c}, translate({c}, '0123456789', ''), '')").cast("bigint")


def _file_row(table: str) -> Column:
    """A number for each row of a derived file, from its key."""
    return {
        "fact_order": lambda: _digits("channel_order_id") * 10 + F.col("line_no").cast("bigint"),
        "fact_shipment": lambda: _digits("shipment_id"),
        "fact_return": lambda: _digits("return_id"),
        "fact_inventory_snapshot": lambda: ((_digits("item_id") * 3 + _digits("lot_id")) * 60 + F.datediff(
            F.col("snapshot_date").cast("date"), F.lit("1998-01-01").cast("date"))) * 5 + _digits("warehouse_id"),
        "fact_po": lambda: _digits("po_id"),
        "fact_receipt": lambda: _digits("receipt_id") * 2 + F.when(F.col("source_system") == "ERP", 1).otherwise(0),
    }.get(table, lambda: F.lit(None).cast("bigint"))()


#: The file that stands for each table.
FILE_NAMES = {
    "fact_order": "orders.csv", "fact_shipment": "shipments.csv", "fact_return": "returns.csv", "fact_inventory_snapshot": "inventory.csv",
    "fact_po": "purchases.csv", "fact_receipt": "receipts.csv", "fact_settlement": "settlements.csv", "fact_charge_actual": "charges.csv",
    "fact_exchange_rate": "rates.csv", "fact_cost_structure": "costs.csv",
}


def _file(cat: Catalog, name: str) -> DataFrame:
    """A table's rows as text, one quantity in sixteen below zero."""
    if name == "fact_shipment":
        return cat["shipment_rows"]
    df = cat["raw_charges" if name == "fact_charge_actual" else name]
    first, columns = CONTRACTS[name].key[0], df.columns
    text = F.col(first).cast("string")
    below = F.substring(F.md5(text), 1, 1) == "0"
    if dict(df.dtypes)[first] == "date":
        # Many rows share a day: its text and its hash are made once a day. There are no more days than a task can hold.
        days = df.select(first).distinct().select(F.col(first).alias("_day"), text.alias("_text"), below.alias("_below"))
        df = df.join(F.broadcast(days), F.col(first) == F.col("_day"), "left")
        text, below = F.col("_text"), F.col("_below")
    for c in quality.QUANTITY_COLUMNS:
        if c in columns:
            df = df.withColumn(c, F.when(below, -F.col(c)).otherwise(F.col(c)))
    return df.select(*[(text if c == first else F.col(c).cast("string")).alias(c) for c in columns])


#: Files of tables that take a join or a look at all shipments to make, written once. The others are made anew by each pass,
#: which costs less than to write them as text; rows dealt out by a key are then counted by key where they are.
WRITTEN = ("fact_order", "fact_charge_actual", "fact_exchange_rate")


@table("dq_report")
def dq_report(cat: Catalog) -> DataFrame:
    """Every check over the files of the ten tables, with the rows that break a quantity check."""
    out, rows = None, {}
    share_lines(cat)
    for name, file_name in FILE_NAMES.items():
        made = _file(cat, name)
        made = materialize(made, f"file-{name}") if name in WRITTEN else made
        # Counts, keys and offending rows each read it. Only offending rows are numbered.
        rows[name] = made.withColumns({"file_name": F.lit(file_name), "row_no": _file_row(name)})
        one = quality.report_by_file(rows[name], name, cat.policy, "file_name", "row_no")
        out = one if out is None else out.unionByName(one)
    pairs = [("fact_shipment", "qty_shipped", cat["fact_inventory_snapshot"], "onhand_qty", "cross_shipment_vs_inventory"),
             ("fact_return", "qty_returned", cat["fact_shipment"], "qty_shipped", "cross_return_vs_shipment")]
    for name, left, other, right, check in pairs:
        over = quality.total_exceeds(rows[name], left, other, right, check)
        out = out.unionByName(over.withColumns({"file_name": F.lit(FILE_NAMES[name]), "sample": F.lit(None).cast("string")}))
    return materialize(out, "dq-report")


@query("dq_gate")
def dq_gate(cat: Catalog) -> DataFrame:
    return quality.gate(cat["dq_report"], ["file_name"])


@query("file_and_dq_logs")
def file_and_dq_logs(cat: Catalog) -> DataFrame:
    """Log rows of a run: one per file and check, with the file's final status."""
    verdict = cat["dq_gate"].select(
        "file_name", F.when(F.col("rejected"), "dq_failed").otherwise("success").alias("file_status"))
    return cat["dq_report"].join(verdict, "file_name").withColumn("batch_id", F.lit(42))


@query("policy_validate")
def policy_validate(cat: Catalog) -> DataFrame:
    """Charge lines whose type or basis the policy does not support."""
    known = cat.policy.basis_candidates(cat.spark).select("charge_type").distinct().withColumn("_known", F.lit(True))
    return cat["raw_charges"].join(known, "charge_type", "left").filter("_known IS NULL").select(
        "invoice_no", "invoice_line_no", "charge_type", F.lit("unknown charge type").alias("problem"))


# ---- uploads ------------------------------------------------------------
INVENTORY_KEY = ["snapshot_date", "warehouse_id", "item_id", "lot_id"]


@query("dq_upload_keys")
def dq_upload_keys(cat: Catalog) -> DataFrame:
    return quality.repeated_keys(
        cat["upload_inventory_snapshot"], "source_file_name", "source_row_no", INVENTORY_KEY)


@query("dq_upload_nonneg")
def dq_upload_nonneg(cat: Catalog) -> DataFrame:
    columns = ["onhand_qty", "sellable_qty", "blocked_qty", "reserved_qty"]
    return quality.flagged(
        cat["upload_inventory_snapshot"], ["source_file_name", "source_row_no"],
        [(f"{c} is negative", F.col(c) < 0) for c in columns])


@query("dq_upload_datasets")
def dq_upload_datasets(cat: Catalog) -> DataFrame:
    """Repeated keys and negative numbers in the uploads of all seven datasets, counted by problem."""
    out = None
    share_lines(cat)
    for dataset, promotion in PROMOTIONS.items():
        rows = dataset_upload(cat, dataset)
        numbers = [c for c, kind in CONTRACTS[promotion["core"]].columns.items() if kind == "DOUBLE" and c in rows.columns]
        found = quality.repeated_keys(rows, "source_file_name", "source_row_no", promotion["key"]).unionByName(
            quality.flagged(rows, ["source_file_name", "source_row_no"], [(f"{c} is negative", F.col(c) < 0) for c in numbers]))
        one = found.groupBy("source_file_name", "problem").agg(F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dq_upload_inventory")
def dq_upload_inventory(cat: Catalog) -> DataFrame:
    onhand, sellable, blocked = F.col("onhand_qty"), F.col("sellable_qty"), F.col("blocked_qty")
    return quality.flagged(cat["upload_inventory_snapshot"], ["source_file_name", "source_row_no"], [
        ("sellable_qty exceeds onhand_qty", sellable > onhand),
        ("blocked_qty exceeds onhand_qty", blocked > onhand),
        ("sellable + blocked + reserved exceeds onhand_qty", sellable + blocked + F.col("reserved_qty") > onhand),
    ])


@query("dq_upload_dates")
def dq_upload_dates(cat: Catalog) -> DataFrame:
    po = quality.flagged(cat["upload_purchase_order"], ["source_file_name", F.col("po_id").alias("row_key")], [
        ("eta_date before po_date", F.col("eta_date") < F.col("po_date"))])
    receipt = quality.flagged(cat["upload_receipt"], ["source_file_name", F.col("receipt_id").alias("row_key")], [
        ("mfg_date after receipt_date", F.col("mfg_date") > F.col("receipt_date")),
        ("expiry_date before mfg_date", F.col("expiry_date") < F.col("mfg_date"))])
    ship = quality.flagged(cat["upload_shipment"], ["source_file_name", F.col("raw_id").cast("string").alias("row_key")], [
        ("ship_date before promised_ship_date", F.col("ship_date") < F.col("promised_ship_date")),
        ("delivered_at before ship_date", F.col("delivered_at") < F.col("ship_date"))])
    return po.unionByName(receipt).unionByName(ship)


@query("dq_upload_periods")
def dq_upload_periods(cat: Catalog) -> DataFrame:
    sales = quality.flagged(cat["upload_sales"], ["source_file_name", "line_no"], [
        ("order_date outside period", month("order_date") != F.col("period")),
        ("ship_date outside period", month("ship_date") != F.col("period"))])
    charge = quality.flagged(cat["upload_charge"], ["source_file_name", F.col("invoice_line_no").alias("line_no")], [
        ("invoice_date outside period", month("invoice_date") != F.col("period")),
        ("reference_period after period", F.col("reference_period") > F.col("period"))])
    return sales.unionByName(charge)


def error_report(problems: DataFrame, at_most: int | None = None) -> DataFrame:
    """What a sender sees: every problem of a file, or the first ``at_most``."""
    if at_most is None:
        return problems
    w = Window.partitionBy("source_file_name").orderBy("line_no", "problem")
    return problems.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= at_most).drop("_rn")


@query("dq_upload_error_report")
def dq_upload_error_report(cat: Catalog) -> DataFrame:
    return error_report(cat["dq_upload_periods"])
