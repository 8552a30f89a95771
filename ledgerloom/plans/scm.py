"""Inventory, procurement, shipment and return marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import (
    days_between, exact_avg, exact_sum, lookup, month, n_unique, ratio, sum0,
)
from ledgerloom.operators import expiry
from ledgerloom.operators.asof import asof_join
from ledgerloom.operators.ranking import large_keys

# Rows that one task puts in order.
RANGE_ROWS = 500_000
LOT = ["snapshot_date", "warehouse_id", "item_id", "lot_id"]


@table("lots")
def lots(cat: Catalog) -> DataFrame:
    """Snapshot lots with final expiry and the sellable split."""
    enriched = expiry.final_expiry(
        cat["fact_inventory_snapshot"], cat["dim_item"], cat["fact_receipt"], cat.policy)
    return expiry.sellable_split(enriched)


@query("final_expiry")
def final_expiry(cat: Catalog) -> DataFrame:
    return cat["lots"].select(*LOT, "onhand_qty", "item_type", "final_expiry_date", "effective_min_sellable_days")


@query("sellable_qty")
def sellable_qty(cat: Catalog) -> DataFrame:
    return cat["lots"].select(*LOT, "onhand_qty", "expired_qty", "blocked_qty", "sellable_qty")


def _lot_counts(cat: Catalog) -> tuple[int, DataFrame | None]:
    return large_keys(cat["fact_inventory_snapshot"], expiry.FEFO_KEYS)


@query("fefo_rank")
def fefo_rank(cat: Catalog) -> DataFrame:
    return expiry.fefo_rank(cat["lots"], _lot_counts(cat)[1]).select(*LOT, "final_expiry_date", "fefo_rank")


@query("expiry_bucket")
def expiry_bucket(cat: Catalog) -> DataFrame:
    return expiry.expiry_bucket(cat["lots"], cat.policy).select(*LOT, "days_to_expiry", "expiry_bucket")


@query("expired_issues")
def expired_issues(cat: Catalog) -> DataFrame:
    """One critical issue per expired lot, with a repeatable id."""
    lots = cat["lots"].filter("expired_qty > 0")
    entity = F.concat_ws("|", "item_id", "lot_id", "warehouse_id")
    period = F.col("snapshot_date").cast("string")
    return lots.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit("EXPIRED_STOCK"), entity, period), 256), 1, 12).alias("issue_id"),
        F.lit("EXPIRED_STOCK").alias("issue_type"),
        F.lit("CRITICAL").alias("severity"),
        F.lit("expiry").alias("domain"),
        F.lit("item_lot").alias("entity_type"),
        entity.alias("entity_id"),
        period.alias("period"),
        F.concat(
            F.lit("Expired stock: item="), "item_id", F.lit(", lot="), "lot_id", F.lit(", warehouse="), "warehouse_id",
            F.lit(", qty="), F.col("expired_qty").cast("bigint"), F.lit(", expiry="), "final_expiry_date",
        ).alias("detail"),
    )


@query("mart_inventory_onhand")
def mart_inventory_onhand(cat: Catalog) -> DataFrame:
    df = expiry.fefo_rank(expiry.expiry_bucket(cat["lots"], cat.policy), _lot_counts(cat)[1])
    return df.select(
        *LOT, "onhand_qty", "sellable_qty", "blocked_qty", "expired_qty", "final_expiry_date",
        "expiry_bucket", "fefo_rank", F.col("effective_min_sellable_days").alias("min_sellable_days"),
    )


@query("mart_open_po")
def mart_open_po(cat: Catalog) -> DataFrame:
    received = (
        cat["fact_receipt"].filter("po_id IS NOT NULL").groupBy("po_id", "item_id")
        .agg(exact_sum("qty_received").alias("qty_received"), F.min("receipt_date").alias("first_receipt_date"))
    )
    as_of = F.lit(cat.policy.as_of)
    got = F.coalesce("qty_received", F.lit(0.0))
    return cat["fact_po"].join(received, ["po_id", "item_id"], "left").select(
        "po_id", "item_id", "supplier_id", "po_date", "eta_date", "first_receipt_date", "qty_ordered",
        got.alias("qty_received"),
        F.greatest(F.col("qty_ordered") - got, F.lit(0.0)).alias("qty_open"),
        F.when(F.col("eta_date") < as_of, days_between(as_of, "eta_date")).otherwise(F.lit(0)).alias("delay_days"),
        days_between("first_receipt_date", "po_date").alias("po_lead_days"),
        days_between("first_receipt_date", "eta_date").alias("eta_vs_actual_days"),
        month("po_date").alias("period"),
    )


@table("daily_demand")
def daily_demand(cat: Catalog) -> DataFrame:
    """Sales quantity per calendar day of the span shipped, by warehouse and item."""
    per_item = (
        cat["fact_shipment"].filter("channel_order_id IS NOT NULL").groupBy("warehouse_id", "item_id")
        .agg(exact_sum("qty_shipped").alias("qty"), F.min("ship_date").alias("lo"), F.max("ship_date").alias("hi"))
    )
    span = F.greatest(days_between("hi", "lo") + 1, F.lit(1))
    return per_item.select("warehouse_id", "item_id", (F.col("qty") / span).alias("avg_daily_demand"))


@table("latest_stock")
def latest_stock(cat: Catalog) -> DataFrame:
    """On-hand and sellable quantity of the newest snapshot per warehouse and item."""
    daily = cat["lots"].groupBy("warehouse_id", "item_id", "item_type", "snapshot_date").agg(
        exact_sum("onhand_qty").alias("onhand"), exact_sum("sellable_qty").alias("sellable"))
    return daily.groupBy("warehouse_id", "item_id", "item_type").agg(
        F.max_by("onhand", "snapshot_date").alias("onhand_qty"),
        F.max_by("sellable", "snapshot_date").alias("sellable_qty"),
        F.max("snapshot_date").alias("as_of_date"),
    )


def _with_demand(cat: Catalog) -> DataFrame:
    df = cat["latest_stock"].join(cat["daily_demand"], ["warehouse_id", "item_id"], "left")
    return df.withColumn("avg_daily_demand", F.coalesce("avg_daily_demand", F.lit(0.0)))


INFINITY = float("inf")


@query("mart_stockout_risk")
def mart_stockout_risk(cat: Catalog) -> DataFrame:
    demand = F.col("avg_daily_demand")
    df = _with_demand(cat).withColumns({
        "days_of_cover": ratio(F.col("sellable_qty"), demand, INFINITY),
        "threshold_days": F.lit(cat.policy.stockout_days),
    })
    return df.select(
        "item_id", "warehouse_id", "sellable_qty", "avg_daily_demand", "days_of_cover", "threshold_days",
        (F.col("days_of_cover") < F.col("threshold_days")).alias("risk_flag"), "as_of_date",
    )


@query("mart_overstock")
def mart_overstock(cat: Catalog) -> DataFrame:
    p = cat.policy
    demand, onhand = F.col("avg_daily_demand"), F.col("onhand_qty")
    df = _with_demand(cat).withColumn("item_type", F.coalesce("item_type", F.lit("FG"))).withColumns({
        "days_on_hand": ratio(onhand, demand, INFINITY),
        "doh_threshold": lookup(F.col("item_type"), p.doh_overstock, p.doh_default),
    }).withColumn("overstock_flag", F.col("days_on_hand") > F.col("doh_threshold"))
    excess = F.greatest(onhand - demand * F.col("doh_threshold"), F.lit(0.0))
    return df.select(
        "item_id", "warehouse_id", "item_type", "onhand_qty", "avg_daily_demand", "days_on_hand", "doh_threshold",
        "overstock_flag", F.when(F.col("overstock_flag"), excess).otherwise(F.lit(0.0)).alias("overstock_qty"),
        "as_of_date",
    )


@table("unit_cost")
def unit_cost(cat: Catalog) -> DataFrame:
    """Cost components summed, so a version is one row per item and start date."""
    return cat["fact_cost_structure"].groupBy("item_id", "effective_from").agg(
        exact_sum("cost_per_unit_krw").alias("unit_cost_krw"))


@query("mart_expiry_risk")
def mart_expiry_risk(cat: Catalog) -> DataFrame:
    df = expiry.expiry_bucket(cat["lots"], cat.policy).filter("final_expiry_date IS NOT NULL")
    df = asof_join(df, cat["unit_cost"], ["item_id"], "snapshot_date", "effective_from", ["unit_cost_krw"])
    return df.select(
        "item_id", "warehouse_id", "lot_id", "onhand_qty", "final_expiry_date", "days_to_expiry", "expiry_bucket",
        (F.col("onhand_qty") * F.col("unit_cost_krw")).alias("risk_value_krw"),
        F.col("snapshot_date").alias("as_of_date"),
    )


@query("mart_fefo_pick_list")
def mart_fefo_pick_list(cat: Catalog) -> DataFrame:
    """Laid out in ranges of the final order first, so ranking and ordering move the rows once."""
    columns = ["warehouse_id", "item_id", "lot_id", "onhand_qty", "sellable_qty", "final_expiry_date", "snapshot_date"]
    rows, large = _lot_counts(cat)
    lots = cat["lots"].select(*columns).repartitionByRange(rows // RANGE_ROWS + 1, "warehouse_id", "item_id")
    return expiry.fefo_rank(lots, large).select(
        "warehouse_id", "item_id", "lot_id", "onhand_qty", "sellable_qty", "final_expiry_date", "fefo_rank",
        "snapshot_date",
    ).orderBy("warehouse_id", "item_id", F.asc_nulls_last("fefo_rank"))


@query("mart_service_level")
def mart_service_level(cat: Catalog) -> DataFrame:
    first = (
        cat["fact_shipment"].filter("channel_order_id IS NOT NULL").groupBy("channel_order_id")
        .agg(F.min("ship_date").alias("first_ship"))
    )
    in_time = F.col("first_ship") <= F.date_add("order_date", cat.policy.on_time_days)
    weekly = cat["fact_order"].join(first, "channel_order_id", "left").groupBy(
        F.date_trunc("week", "order_date").cast("date").alias("week_start"), "channel_store_id",
    ).agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(in_time).alias("shipped_on_time"))
    return weekly.withColumn("service_level_pct", F.col("shipped_on_time") / F.col("total_orders"))


@query("mart_shipment_performance")
def mart_shipment_performance(cat: Catalog) -> DataFrame:
    ordered = (
        cat["fact_order"].filter("channel_order_id IS NOT NULL").groupBy("channel_order_id")
        .agg(F.min("order_date").alias("order_date"))
    )
    in_time = F.col("ship_date") <= F.date_add("order_date", cat.policy.on_time_days)
    agg = cat["fact_shipment"].join(ordered, "channel_order_id", "left").groupBy(
        month("ship_date").alias("period"), "warehouse_id", "channel_store_id",
    ).agg(
        n_unique("shipment_id").alias("total_shipments"),
        sum0("qty_shipped").alias("total_qty_shipped"),
        sum0("weight").alias("total_weight"),
        sum0("volume_cbm").alias("total_volume_cbm"),
        exact_avg("qty_shipped").alias("avg_qty_per_shipment"),
        exact_avg(days_between("ship_date", "order_date")).alias("avg_lead_days"),
        F.count_if(in_time).alias("on_time_count"),
    )
    return agg.withColumn("on_time_pct", F.col("on_time_count") / F.col("total_shipments"))


@query("mart_shipment_daily")
def mart_shipment_daily(cat: Catalog) -> DataFrame:
    return cat["fact_shipment"].groupBy("ship_date", "warehouse_id").agg(
        n_unique("shipment_id").alias("shipment_count"),
        sum0("qty_shipped").alias("qty_shipped"),
        sum0("weight").alias("weight"),
        sum0("volume_cbm").alias("volume_cbm"),
        n_unique("channel_order_id").alias("unique_orders"),
        n_unique("item_id").alias("unique_items"),
    )


@query("mart_return_analysis")
def mart_return_analysis(cat: Catalog) -> DataFrame:
    stores = cat["fact_order"].filter("channel_order_id IS NOT NULL").select(
        "channel_order_id", "channel_store_id").distinct()
    returned = cat["fact_return"].withColumn("period", month("return_date")).join(
        stores, "channel_order_id", "left",
    ).groupBy("period", "item_id", "warehouse_id", "channel_store_id", "reason", "disposition").agg(
        n_unique("return_id").alias("return_count"), sum0("qty_returned").alias("qty_returned"))
    shipped = cat["fact_shipment"].groupBy(month("ship_date").alias("period"), "item_id", "warehouse_id").agg(
        exact_sum("qty_shipped").alias("qty_shipped"))
    return returned.join(shipped, ["period", "item_id", "warehouse_id"], "left").withColumn(
        "return_rate", ratio(F.col("qty_returned"), F.col("qty_shipped"), 0.0))


@query("mart_return_daily")
def mart_return_daily(cat: Catalog) -> DataFrame:
    keys = ["return_date", "warehouse_id"]
    returns = cat["fact_return"]
    daily = returns.groupBy(*keys).agg(
        n_unique("return_id").alias("return_count"),
        sum0("qty_returned").alias("qty_returned"),
        n_unique("channel_order_id").alias("unique_orders"),
        n_unique("item_id").alias("unique_items"),
    )
    # Counting per reason first keeps the mode small however many rows a day has.
    per_reason = returns.filter("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    top = per_reason.groupBy(*keys).agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("top_reason"))
    return daily.join(top, keys, "left")


@query("mart_inventory_turnover")
def mart_inventory_turnover(cat: Catalog) -> DataFrame:
    keys = ["period", "item_id", "warehouse_id"]
    daily = cat["fact_inventory_snapshot"].groupBy("snapshot_date", "item_id", "warehouse_id").agg(
        exact_sum("onhand_qty").alias("qty"))
    ends = daily.groupBy(month("snapshot_date").alias("period"), "item_id", "warehouse_id").agg(
        F.min_by("qty", "snapshot_date").alias("first_qty"), F.max_by("qty", "snapshot_date").alias("last_qty"))
    shipped = cat["fact_shipment"].groupBy(month("ship_date").alias("period"), "item_id", "warehouse_id").agg(
        exact_sum("qty_shipped").alias("shipped"))
    zero = F.lit(0.0)
    df = ends.join(shipped, keys, "left").select(
        *keys,
        ((F.coalesce("first_qty", zero) + F.coalesce("last_qty", zero)) / 2).alias("avg_inventory"),
        F.coalesce("shipped", zero).alias("cogs_or_shipment"),
    ).withColumn("turnover_ratio", ratio(F.col("cogs_or_shipment"), F.col("avg_inventory")))
    return df.withColumn("days_on_hand", ratio(F.lit(365.0), F.col("turnover_ratio")))


@query("lead_time_analysis")
def lead_time_analysis(cat: Catalog) -> DataFrame:
    """Lead-time statistics; the exact percentiles keep one counter per distinct day count."""
    po = cat["fact_po"].select(
        "po_id", "item_id", "supplier_id", "po_date",
        F.coalesce("eta_date", F.date_add("po_date", cat.policy.default_eta_days)).alias("eta"))
    got = cat["fact_receipt"].select("po_id", "item_id", "receipt_date")
    df = po.join(got, ["po_id", "item_id"]).select(
        month("po_date").alias("period"), "supplier_id", "item_id",
        days_between("receipt_date", "po_date").alias("lead"),
        days_between("receipt_date", "eta").alias("vs_eta"),
    )
    late = F.col("vs_eta") > 0
    return df.groupBy("period", "supplier_id", "item_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        exact_avg("lead").alias("avg_lead_days"),
        F.min("lead").alias("min_lead_days"),
        F.max("lead").alias("max_lead_days"),
        F.percentile("lead", 0.25).alias("q1_lead_days"),
        F.percentile("lead", 0.5).alias("median_lead_days"),
        F.percentile("lead", 0.75).alias("q3_lead_days"),
        exact_avg("vs_eta").alias("avg_eta_vs_actual"),
        (F.count_if(late) / F.count(F.lit(1))).alias("late_po_ratio"),
        exact_avg(F.when(late, F.col("vs_eta"))).alias("avg_delay_days"),
    )
