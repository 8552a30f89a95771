"""Small typed input frames for unit tests."""

import datetime as dt

SCHEMAS = {
    "fact_shipment": "shipment_id string, ship_date date, warehouse_id string, item_id string, lot_id string, "
                     "qty_shipped double, weight double, volume_cbm double, channel_order_id string, "
                     "channel_store_id string, source_system string",
    "fact_return": "return_id string, return_date date, warehouse_id string, item_id string, lot_id string, "
                   "qty_returned double, channel_order_id string, reason string, disposition string",
    "fact_order": "channel_order_id string, line_no bigint, order_date date, channel_store_id string, item_id string, "
                  "qty_ordered double, ship_from_warehouse_id string",
    "fact_settlement": "settlement_id string, line_no bigint, period string, channel_store_id string, item_id string, "
                       "currency string, gross_sales double, discounts double, fees double, refunds double, "
                       "net_payout double",
    "fact_exchange_rate": "period string, currency string, rate_to_krw double",
    "fact_cost_structure": "item_id string, cost_component string, effective_from date, cost_per_unit_krw double",
    "fact_charge_actual": "invoice_no string, invoice_line_no bigint, charge_type string, amount double, "
                          "currency string, period string, warehouse_id string, channel_store_id string",
    "fact_po": "po_id string, po_date date, supplier_id string, item_id string, qty_ordered double, eta_date date",
    "fact_receipt": "receipt_id string, receipt_date date, warehouse_id string, item_id string, qty_received double, "
                    "po_id string, lot_id string, mfg_date date, source_system string",
    "fact_inventory_snapshot": "snapshot_date date, warehouse_id string, item_id string, lot_id string, "
                               "onhand_qty double, expiry_date date, qc_status string, hold_flag boolean",
    "dim_item": "item_id string, item_type string, min_sellable_days int, qc_required_flag boolean, "
                "shelf_life_days int, expiry_control_flag boolean",
    "period_events": "period string, event string, at date, actor string",
}


def day(text):
    return dt.date.fromisoformat(text) if text else None


def frame(spark, name, rows=()):
    """A frame of ``rows`` (dicts); absent columns are NULL, ISO text in date columns is a date."""
    fields = [part.strip().split(" ") for part in SCHEMAS[name].split(",")]
    data = [
        tuple(day(r[c]) if kind == "date" and isinstance(r.get(c), str) else r.get(c) for c, kind in fields)
        for r in rows
    ]
    return spark.createDataFrame(data, SCHEMAS[name])


def catalog(spark, policy=None, **tables):
    from ledgerloom import Catalog

    return Catalog(spark, {name: frame(spark, name, tables.get(name, ())) for name in SCHEMAS}, policy)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
