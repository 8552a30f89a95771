"""Anomaly detectors over daily and monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query
from ledgerloom.functions.exprs import exact_sum, sum0
from ledgerloom.operators.anomaly import detect
from ledgerloom.sources.canonical import share_lines


@query("anomaly_timeseries")
def anomaly_timeseries(cat: Catalog) -> DataFrame:
    return detect(cat["daily_events"], "day", "value", ["event_type"], "daily_event_value", "event_type", cat.policy)


@query("anomaly_shipments")
def anomaly_shipments(cat: Catalog) -> DataFrame:
    daily = cat["fact_shipment"].groupBy("ship_date", "warehouse_id").agg(sum0("qty_shipped").alias("qty"))
    return detect(daily, "ship_date", "qty", ["warehouse_id"], "daily_shipment_qty", "warehouse", cat.policy)


@query("anomaly_returns")
def anomaly_returns(cat: Catalog) -> DataFrame:
    daily = cat["fact_return"].groupBy("return_date", "warehouse_id").agg(sum0("qty_returned").alias("qty"))
    return detect(daily, "return_date", "qty", ["warehouse_id"], "daily_return_qty", "warehouse", cat.policy)


@query("anomaly_inventory")
def anomaly_inventory(cat: Catalog) -> DataFrame:
    daily = cat["fact_inventory_snapshot"].groupBy("snapshot_date", "item_id", "warehouse_id").agg(
        sum0("onhand_qty").alias("qty"))
    return detect(daily, "snapshot_date", "qty", ["item_id", "warehouse_id"], "inventory_level", "item:warehouse",
                  cat.policy)


@query("anomaly_revenue")
def anomaly_revenue(cat: Catalog) -> DataFrame:
    monthly = cat["mart_pnl_revenue"].groupBy("period", "channel_store_id").agg(
        exact_sum(F.coalesce("net_revenue_krw", F.lit(0.0))).alias("revenue"))
    return detect(monthly, "period", "revenue", ["channel_store_id"], "channel_revenue", "channel", cat.policy)


DETECTORS = ["anomaly_shipments", "anomaly_returns", "anomaly_inventory", "anomaly_revenue"]


@query("mart_anomaly_signals")
def mart_anomaly_signals(cat: Catalog) -> DataFrame:
    share_lines(cat)
    out = cat[DETECTORS[0]]
    for name in DETECTORS[1:]:
        out = out.unionByName(cat[name])
    return out.withColumn("detected_at", F.lit(cat.policy.as_of))
