"""Canonical star schema derived from the raw parquet tables.

Each builder is a projection of ``li`` (line items with repeated keys
resolved), so column pruning still reaches the parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, table
from ledgerloom.functions.exprs import literal_table, month
from ledgerloom.session import materialize

SNAPSHOT_DAYS = 20
WAREHOUSES, LOTS = 5, 3
# Snapshot rows that one task makes.
TASK_ROWS = 250_000
# Line items that one task puts in order.
LINE_ROWS = 500_000


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _tag(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


@table("li")
def li(cat: Catalog) -> DataFrame:
    """One line per (order, line number): the latest shipped version wins.

    Lines are dealt out by key first: keys seldom repeat, so dropping losers before the
    shuffle would sort a whole piece of the file in the task that reads it, for little. How
    many tasks they go to follows the number of lines, which Parquet footers tell.
    """
    lines = cat.source("lineitem")
    tasks = max(cat.spark.sparkContext.defaultParallelism, math.ceil(lines.count() / LINE_ROWS))
    raw = lines.repartition(tasks, "l_orderkey", "l_linenumber").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    return raw.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def share_lines(cat: Catalog) -> None:
    """Write the line items once, for a query that reads them through several facts."""
    if cat.source_dir is not None and "li" not in cat.notes:
        cat["li"] = cat.notes["li"] = materialize(cat["li"], "lines")


def _warehouse(key: Column) -> Column:
    return _tag("W", key % 5)


def _store(order_key: str) -> Column:
    return _tag("S", F.col(order_key) % 10)


def _line_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))


@table("dim_item")
def dim_item(cat: Catalog) -> DataFrame:
    key = F.col("p_partkey")
    kind = key % 4
    return cat.source("part").select(
        _text("p_partkey").alias("item_id"),
        F.when(kind == 0, "RM").when(kind == 1, "PM").when(kind == 2, "WIP").otherwise("FG").alias("item_type"),
        F.when(key % 5 == 0, F.lit(45)).alias("min_sellable_days"),
        (key % 19 == 0).alias("qc_required_flag"),
        F.lit(365).alias("shelf_life_days"),
        F.lit(True).alias("expiry_control_flag"),
    )


@table("fact_order")
def fact_order(cat: Catalog) -> DataFrame:
    orders = cat.source("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    lines = cat["li"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.lit("OMS").alias("source_system"),
        _text("o_orderkey").alias("channel_order_id"),
        F.coalesce("l_linenumber", F.lit(1)).cast("bigint").alias("line_no"),
        "order_date",
        _store("o_orderkey").alias("channel_store_id"),
        F.coalesce("l_partkey", F.col("o_orderkey") % 100).cast("string").alias("item_id"),
        F.coalesce("l_quantity", F.lit(10.0)).alias("qty_ordered"),
        _warehouse(F.coalesce("l_suppkey", "o_orderkey")).alias("ship_from_warehouse_id"),
    )


@table("fact_shipment")
def fact_shipment(cat: Catalog) -> DataFrame:
    return cat["li"].filter("l_linestatus = 'F'").select(
        F.lit("WMS").alias("source_system"),
        _line_id("").alias("shipment_id"),
        F.col("l_shipdate").alias("ship_date"),
        _warehouse(F.col("l_suppkey")).alias("warehouse_id"),
        _text("l_partkey").alias("item_id"),
        _tag("L", F.col("l_partkey") % 3).alias("lot_id"),
        F.col("l_quantity").alias("qty_shipped"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") * 0.5).alias("weight"),
        (F.col("l_quantity") * 0.01).alias("volume_cbm"),
        F.when(F.col("l_linenumber") != 7, _text("l_orderkey")).alias("channel_order_id"),
        _store("l_orderkey").alias("channel_store_id"),
    )


@table("fact_return")
def fact_return(cat: Catalog) -> DataFrame:
    why = F.col("l_partkey") % 4
    what = F.col("l_suppkey") % 3
    return cat["li"].filter("l_linestatus = 'F' AND l_returnflag = 'R'").select(
        F.lit("WMS").alias("source_system"),
        _line_id("R").alias("return_id"),
        F.date_add("l_shipdate", F.lit(5) + F.col("l_linenumber")).alias("return_date"),
        _warehouse(F.col("l_suppkey")).alias("warehouse_id"),
        _text("l_partkey").alias("item_id"),
        _tag("L", F.col("l_partkey") % 3).alias("lot_id"),
        F.ceil(F.col("l_quantity") / 5).cast("double").alias("qty_returned"),
        F.when(F.col("l_linenumber") != 7, _text("l_orderkey")).alias("channel_order_id"),
        F.when(why == 0, "DAMAGED").when(why == 1, "WRONG_ITEM").when(why == 2, "CHANGE_OF_MIND").alias("reason"),
        F.when(what == 0, "RESTOCK").when(what == 1, "SCRAP").otherwise("REFURBISH").alias("disposition"),
    )


@table("fact_po")
def fact_po(cat: Catalog) -> DataFrame:
    return cat["li"].filter("l_linestatus = 'O'").select(
        F.lit("ERP").alias("source_system"),
        _line_id("PO").alias("po_id"),
        F.date_sub("l_shipdate", 20).alias("po_date"),
        _text("l_suppkey").alias("supplier_id"),
        _text("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("qty_ordered"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_shipdate")).alias("eta_date"),
        F.lit("USD").alias("currency"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


@table("fact_receipt")
def fact_receipt(cat: Catalog) -> DataFrame:
    """WMS and ERP each book a receipt for part of the open lines."""
    lines = cat["li"].filter("l_linestatus = 'O' AND l_linenumber <= 5")
    systems = F.when(F.col("l_linenumber") <= 4, F.array(F.lit("WMS"), F.lit("ERP"))).otherwise(F.array(F.lit("WMS")))
    lines = lines.withColumn("source_system", F.explode(systems))
    arrived = F.date_add("l_shipdate", (F.col("l_partkey") % 15 - 4).cast("int"))
    return lines.select(
        "source_system",
        F.concat(F.substring("source_system", 1, 1), F.lit("R"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
        .alias("receipt_id"),
        arrived.alias("receipt_date"),
        _warehouse(F.col("l_suppkey")).alias("warehouse_id"),
        _text("l_partkey").alias("item_id"),
        F.when(F.col("source_system") == "WMS", F.floor(F.col("l_quantity") * 0.9).cast("double"))
        .otherwise(F.col("l_quantity")).alias("qty_received"),
        _line_id("PO").alias("po_id"),
        _tag("L", F.col("l_partkey") % 3).alias("lot_id"),
        F.when(F.col("l_partkey") % 8 == 0, F.date_sub(arrived, 30)).alias("mfg_date"),
    )


@table("fact_inventory_snapshot")
def fact_inventory_snapshot(cat: Catalog) -> DataFrame:
    """Every part in each warehouse, lot and day.

    The parts lie in a small file, so they are dealt out before they are multiplied; by item,
    so that what is grouped by item later need not move. A cross join tells the planner how
    many rows come of it, which an explode does not. What depends on the part or on the place
    and day alone is worked out before, not once a row.
    """
    parts, per_part = cat.source("part").select("p_partkey"), WAREHOUSES * LOTS * SNAPSHOT_DAYS
    tasks = max(cat.spark.sparkContext.defaultParallelism, math.ceil(parts.count() * per_part / TASK_ROWS))
    part = F.col("p_partkey")
    dealt = parts.select(
        _text("p_partkey").alias("item_id"), (part * 13).alias("_shelf"), (part * 7).alias("_qty"),
        (part % 4 != 0).alias("_dated"), (part % 17 == 0).alias("hold_flag"))
    cells = cat.spark.range(per_part).select(
        F.expr(f"id % {WAREHOUSES}").alias("wh"), F.expr(f"id div {WAREHOUSES} % {LOTS}").alias("lot"),
        F.expr(f"CAST(id div {WAREHOUSES * LOTS} AS int)").alias("day"),
    ).select(
        F.date_add(F.lit("1998-01-01").cast("date"), F.col("day")).alias("snapshot_date"),
        _tag("W", F.col("wh")).alias("warehouse_id"), _tag("L", F.col("lot")).alias("lot_id"),
        F.when(F.col("lot") == 0, "Released").otherwise("PENDING").alias("qc_status"),
        (F.col("lot") * 37).alias("_lot"), (F.col("wh") * 5 + F.col("lot") * 11 + F.col("day") * 3).alias("_cell"))
    shelf = ((F.col("_shelf") + F.col("_lot")) % 500).cast("int")
    return dealt.repartition(tasks, "item_id").crossJoin(F.broadcast(cells)).select(
        F.lit("WMS").alias("source_system"), "snapshot_date", "warehouse_id", "item_id", "lot_id",
        (40 + (F.col("_qty") + F.col("_cell")) % 60).cast("double").alias("onhand_qty"),
        F.when(F.col("_dated"), F.date_add(F.lit("1998-01-10").cast("date"), shelf)).alias("expiry_date"),
        "qc_status", "hold_flag",
    )


@table("fact_settlement")
def fact_settlement(cat: Catalog) -> DataFrame:
    gross = F.col("l_extendedprice")
    rest = F.col("l_orderkey") % 3
    base = cat["li"].filter("l_linestatus = 'F' AND l_partkey % 23 <> 0").select(
        F.lit("SETTLE").alias("source_system"),
        month("l_shipdate").alias("period"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        _store("l_orderkey").alias("channel_store_id"),
        _text("l_partkey").alias("item_id"),
        F.when(rest == 0, "KRW").when(rest == 1, "USD").otherwise("EUR").alias("currency"),
        gross.alias("gross_sales"),
        (gross * F.col("l_discount")).alias("discounts"),
        (gross * 0.03).alias("fees"),
        F.when(F.col("l_returnflag") == "R", gross * 0.1).otherwise(F.lit(0.0)).alias("refunds"),
    )
    return base.withColumn("settlement_id", F.concat(F.lit("STL-"), F.col("period"))).withColumn(
        "net_payout", F.col("gross_sales") - F.col("discounts") - F.col("fees") - F.col("refunds")
    )


@table("fact_exchange_rate")
def fact_exchange_rate(cat: Catalog) -> DataFrame:
    """USD for every shipped month; EUR only in even months."""
    periods = cat["fact_shipment"].select(month("ship_date").alias("period")).distinct()
    even = F.substring("period", 6, 2).cast("int") % 2 == 0
    rates = F.when(even, F.array(
        F.struct(F.lit("USD").alias("currency"), F.lit(1300.0).alias("rate_to_krw")),
        F.struct(F.lit("EUR").alias("currency"), F.lit(1450.0).alias("rate_to_krw")),
    )).otherwise(F.array(F.struct(F.lit("USD").alias("currency"), F.lit(1300.0).alias("rate_to_krw"))))
    return periods.select("period", F.inline(rates))


@table("fact_cost_structure")
def fact_cost_structure(cat: Catalog) -> DataFrame:
    versions = literal_table(
        cat.spark,
        ["cost_component", "share", "effective_from", "uplift"],
        [(c, s, f, u) for c, s in (("MATERIAL", 0.4), ("LABOR", 0.1))
         for f, u in (("1995-01-01", 1.0), ("1998-01-01", 1.1))],
    ).withColumn("_one", F.lit(1))
    parts = cat.source("part").filter("p_partkey % 13 <> 0").withColumn("_one", F.lit(1))
    return parts.join(F.broadcast(versions), "_one").select(
        _text("p_partkey").alias("item_id"),
        "cost_component",
        F.col("effective_from").cast("date").alias("effective_from"),
        (F.col("p_retailprice") * F.col("share") * F.col("uplift")).alias("cost_per_unit_krw"),
    )


@table("fact_charge_actual")
def fact_charge_actual(cat: Catalog) -> DataFrame:
    """Four scoped charges per shipped month and one unscoped fee each January."""
    months = cat["fact_shipment"].select(month("ship_date").alias("period"), F.month("ship_date").alias("m")).distinct()
    period = F.col("period")

    def line(no: int, kind: str, amount: Column, warehouse: Column) -> Column:
        return F.struct(
            F.lit(no).cast("bigint").alias("invoice_line_no"), F.lit(kind).alias("charge_type"),
            amount.cast("double").alias("amount"), warehouse.alias("warehouse_id"),
        )

    home = _tag("W", F.col("m") % 5)
    scoped = [
        line(no, kind, 100000 + F.col("m") * 1000 + no * 37, home)
        for no, kind in ((1, "LAST_MILE_PARCEL"), (2, "FREIGHT_INTL_SEA"), (3, "3PL_STORAGE_FEE"), (5, "DISPOSAL_FEE"))
    ]
    fee = line(9, "PLATFORM_FEE", F.lit(777777), F.lit(None).cast("string"))
    lines = F.when(F.col("m") == 1, F.array(*scoped, fee)).otherwise(F.array(*scoped))
    return months.select("period", F.inline(lines)).select(
        F.lit("ERP").alias("source_system"),
        F.concat(F.lit("INV-"), period).alias("invoice_no"),
        "invoice_line_no",
        F.last_day(F.concat(period, F.lit("-01")).cast("date")).alias("invoice_date"),
        "charge_type", "amount",
        F.lit("KRW").alias("currency"),
        period.alias("period"),
        "warehouse_id",
        F.lit(None).cast("string").alias("channel_store_id"),
    )


@table("daily_events")
def daily_events(cat: Catalog) -> DataFrame:
    from ledgerloom.functions.exprs import exact_sum

    return cat.source("events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(
        exact_sum("value").alias("value"))
