"""Cross-system reconciliation marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query
from ledgerloom.functions.exprs import exact_sum, month, ratio

def _filled(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(n, F.lit(0.0)) for n in names}


def _relative(delta: Column, base: Column) -> Column:
    """delta / |base|; a change from nothing counts as 1."""
    return F.when(F.abs(base) > 0, delta / F.abs(base)).otherwise(
        F.when(F.abs(delta) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


@query("reco_inventory_movement")
def reco_inventory_movement(cat: Catalog) -> DataFrame:
    """Stock against the previous calendar day plus movements; gaps in days do not match."""
    keys = ["snapshot_date", "warehouse_id", "item_id"]

    def daily(table: str, day: str, qty: str, out: str) -> DataFrame:
        return cat[table].groupBy(F.col(day).alias("snapshot_date"), "warehouse_id", "item_id").agg(
            exact_sum(qty).alias(out))

    today = daily("fact_inventory_snapshot", "snapshot_date", "onhand_qty", "actual_onhand")
    before = today.select(
        F.date_add("snapshot_date", 1).alias("snapshot_date"), "warehouse_id", "item_id",
        F.col("actual_onhand").alias("prev_onhand"))
    df = today.join(before, keys)
    for table, day, qty, out in (
        ("fact_receipt", "receipt_date", "qty_received", "receipts"),
        ("fact_shipment", "ship_date", "qty_shipped", "shipments"),
        ("fact_return", "return_date", "qty_returned", "returns"),
    ):
        df = df.join(daily(table, day, qty, out), keys, "left")
    df = df.withColumns(_filled("receipts", "shipments", "returns")).withColumn(
        "expected_onhand", F.col("prev_onhand") + F.col("receipts") - F.col("shipments") + F.col("returns"),
    ).withColumn("delta", F.col("actual_onhand") - F.col("expected_onhand")).withColumn(
        "delta_ratio", _relative(F.col("delta"), F.col("prev_onhand")))
    size = F.abs("delta_ratio")
    severity = F.when(size >= cat.policy.reco_high, "high").when(size >= cat.policy.reco_warn, "warn").otherwise("ok")
    return df.select(
        *keys, "prev_onhand", "receipts", "shipments", "returns", F.col("delta").alias("adjustments"),
        "expected_onhand", "actual_onhand", "delta", "delta_ratio", severity.alias("severity"))


@query("reco_oms_vs_wms")
def reco_oms_vs_wms(cat: Catalog) -> DataFrame:
    keys = ["period", "item_id", "channel_store_id"]
    ordered = cat["fact_order"].groupBy(month("order_date").alias("period"), *keys[1:]).agg(
        exact_sum("qty_ordered").alias("oms_qty_ordered"))
    shipped = cat["fact_shipment"].filter("channel_store_id IS NOT NULL").groupBy(
        month("ship_date").alias("period"), *keys[1:]).agg(exact_sum("qty_shipped").alias("wms_qty_shipped"))
    return ordered.join(shipped, keys, "full").withColumns(_filled("oms_qty_ordered", "wms_qty_shipped")).withColumns({
        "delta": F.col("oms_qty_ordered") - F.col("wms_qty_shipped"),
        "fulfillment_rate": ratio(F.col("wms_qty_shipped"), F.col("oms_qty_ordered")),
    })


@query("reco_erp_vs_wms_receipt")
def reco_erp_vs_wms_receipt(cat: Catalog) -> DataFrame:
    source = F.upper("source_system")
    erp, wms = source.like("%ERP%"), source.like("%WMS%")
    df = cat["fact_receipt"].filter(F.col("po_id").isNotNull() & (erp | wms)).groupBy(
        month("receipt_date").alias("period"), "item_id", "po_id",
    ).agg(
        exact_sum(F.when(erp, F.col("qty_received"))).alias("erp_qty"),
        exact_sum(F.when(wms, F.col("qty_received"))).alias("wms_qty"))
    return df.withColumns(_filled("erp_qty", "wms_qty")).withColumn("delta", F.col("erp_qty") - F.col("wms_qty"))


@query("reco_settlement_vs_estimated")
def reco_settlement_vs_estimated(cat: Catalog) -> DataFrame:
    keys = ["period", "channel_store_id", "item_id"]
    rates = cat["fact_exchange_rate"].select("period", "currency", "rate_to_krw")
    krw = F.coalesce("net_payout", F.lit(0.0)) * F.coalesce("rate_to_krw", F.lit(cat.policy.allocation_fx_default))
    settled = cat["fact_settlement"].join(rates, ["period", "currency"], "left").groupBy(*keys).agg(
        exact_sum(krw).alias("settlement_revenue_krw"))
    estimated = cat["mart_pnl_revenue"].groupBy(*keys).agg(exact_sum("net_revenue_krw").alias("estimated_revenue_krw"))
    df = settled.join(estimated, keys, "full").withColumns(_filled("settlement_revenue_krw", "estimated_revenue_krw"))
    df = df.withColumn("delta_krw", F.col("settlement_revenue_krw") - F.col("estimated_revenue_krw"))
    return df.withColumn("variance_pct", _relative(F.col("delta_krw"), F.col("estimated_revenue_krw")))


TIE_TOLERANCE = 1e-6


@query("reco_charges_tieout")
def reco_charges_tieout(cat: Catalog) -> DataFrame:
    keys = ["period", "charge_type"]
    invoiced = cat["fact_charge_actual"].groupBy(*keys).agg(exact_sum("amount").alias("invoice_total"))
    units = F.sum(F.col("q") * F.col("n") + F.col("m")).cast("double")
    allocated = cat["allocated_classes"].groupBy(*keys).agg(
        (units / (10 ** cat.policy.allocation_decimals)).alias("allocated_total"))
    df = invoiced.join(allocated, keys, "full").withColumns(_filled("invoice_total", "allocated_total"))
    df = df.withColumn("delta", F.col("invoice_total") - F.col("allocated_total"))
    return df.withColumn("tied", F.abs("delta") < TIE_TOLERANCE)
