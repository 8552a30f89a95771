-- name: reco_inventory_movement
SELECT *, CASE WHEN abs(delta_ratio) >= 0.03 THEN 'high' WHEN abs(delta_ratio) >= 0.01 THEN 'warn' ELSE 'ok' END AS severity
FROM (
  SELECT *, delta AS adjustments,
         CASE WHEN abs(prev_onhand) > 0 THEN delta / abs(prev_onhand) WHEN abs(delta) > 0 THEN 1.0 ELSE 0.0 END AS delta_ratio
  FROM (
    SELECT *, actual_onhand - expected_onhand AS delta
    FROM (
      SELECT t.d AS snapshot_date, t.warehouse_id, t.item_id, p.q AS prev_onhand, coalesce(rc.q, 0.0) AS receipts,
             coalesce(sh.q, 0.0) AS shipments, coalesce(rt.q, 0.0) AS "returns", t.q AS actual_onhand,
             p.q + coalesce(rc.q, 0.0) - coalesce(sh.q, 0.0) + coalesce(rt.q, 0.0) AS expected_onhand
      FROM stock_daily t
      JOIN (SELECT d + 1 AS next_d, warehouse_id, item_id, q FROM stock_daily) p ON p.next_d = t.d AND p.warehouse_id = t.warehouse_id AND p.item_id = t.item_id
      LEFT JOIN (SELECT receipt_date AS d, warehouse_id, item_id, CAST(sum(CAST(qty_received AS DECIMAL(18,4))) AS DOUBLE) AS q
                 FROM fact_receipt GROUP BY 1, 2, 3) rc
        ON rc.d = t.d AND rc.warehouse_id = t.warehouse_id AND rc.item_id = t.item_id
      LEFT JOIN (SELECT ship_date AS d, warehouse_id, item_id, CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS q
                 FROM fact_shipment GROUP BY 1, 2, 3) sh
        ON sh.d = t.d AND sh.warehouse_id = t.warehouse_id AND sh.item_id = t.item_id
      LEFT JOIN (SELECT return_date AS d, warehouse_id, item_id, CAST(sum(CAST(qty_returned AS DECIMAL(18,4))) AS DOUBLE) AS q
                 FROM fact_return GROUP BY 1, 2, 3) rt
        ON rt.d = t.d AND rt.warehouse_id = t.warehouse_id AND rt.item_id = t.item_id) a) b) c

-- name: stock_daily
SELECT snapshot_date AS d, warehouse_id, item_id, CAST(sum(CAST(onhand_qty AS DECIMAL(18,4))) AS DOUBLE) AS q
FROM fact_inventory_snapshot GROUP BY 1, 2, 3

-- name: reco_oms_vs_wms
SELECT *, oms_qty_ordered - wms_qty_shipped AS delta,
       CASE WHEN oms_qty_ordered > 0 THEN wms_qty_shipped / oms_qty_ordered END AS fulfillment_rate
FROM (
  SELECT coalesce(o.period, s.period) AS period, coalesce(o.item_id, s.item_id) AS item_id,
         coalesce(o.channel_store_id, s.channel_store_id) AS channel_store_id,
         coalesce(o.q, 0.0) AS oms_qty_ordered, coalesce(s.q, 0.0) AS wms_qty_shipped
  FROM (SELECT strftime(order_date, '%Y-%m') AS period, item_id, channel_store_id,
               CAST(sum(CAST(qty_ordered AS DECIMAL(18,4))) AS DOUBLE) AS q FROM fact_order GROUP BY 1, 2, 3) o
  FULL JOIN (SELECT strftime(ship_date, '%Y-%m') AS period, item_id, channel_store_id,
                    CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS q FROM fact_shipment GROUP BY 1, 2, 3) s
    ON o.period = s.period AND o.item_id = s.item_id AND o.channel_store_id = s.channel_store_id) x

-- name: reco_erp_vs_wms_receipt
SELECT *, erp_qty - wms_qty AS delta
FROM (
  SELECT strftime(receipt_date, '%Y-%m') AS period, item_id, po_id,
         CAST(coalesce(sum(CAST(qty_received AS DECIMAL(18,4))) FILTER (WHERE upper(source_system) LIKE '%ERP%'), 0) AS DOUBLE) AS erp_qty,
         CAST(coalesce(sum(CAST(qty_received AS DECIMAL(18,4))) FILTER (WHERE upper(source_system) LIKE '%WMS%'), 0) AS DOUBLE) AS wms_qty
  FROM fact_receipt WHERE po_id IS NOT NULL GROUP BY 1, 2, 3) x

-- name: reco_settlement_vs_estimated
SELECT *, CASE WHEN abs(estimated_revenue_krw) > 0 THEN delta_krw / abs(estimated_revenue_krw)
               WHEN abs(delta_krw) > 0 THEN 1.0 ELSE 0.0 END AS variance_pct
FROM (
  SELECT *, settlement_revenue_krw - estimated_revenue_krw AS delta_krw
  FROM (
    SELECT coalesce(s.period, e.period) AS period, coalesce(s.channel_store_id, e.channel_store_id) AS channel_store_id,
           coalesce(s.item_id, e.item_id) AS item_id, coalesce(s.v, 0.0) AS settlement_revenue_krw,
           coalesce(e.v, 0.0) AS estimated_revenue_krw
    FROM (SELECT s.period, channel_store_id, item_id,
                 CAST(sum(CAST(coalesce(net_payout, 0.0) * coalesce(rate_to_krw, 1.0) AS DECIMAL(18,4))) AS DOUBLE) AS v
          FROM fact_settlement s LEFT JOIN fact_exchange_rate x ON s.period = x.period AND s.currency = x.currency
          GROUP BY 1, 2, 3) s
    FULL JOIN (SELECT period, channel_store_id, item_id, CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS v
               FROM mart_pnl_revenue GROUP BY 1, 2, 3) e
      ON s.period = e.period AND s.channel_store_id = e.channel_store_id AND s.item_id = e.item_id) a) b

-- name: reco_charges_tieout
SELECT *, invoice_total - allocated_total AS delta, abs(invoice_total - allocated_total) < 1e-6 AS tied
FROM (
  SELECT coalesce(i.period, a.period) AS period, coalesce(i.charge_type, a.charge_type) AS charge_type,
         coalesce(i.v, 0.0) AS invoice_total, coalesce(a.v, 0.0) AS allocated_total
  FROM (SELECT period, charge_type, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS v
        FROM fact_charge_actual GROUP BY 1, 2) i
  FULL JOIN (SELECT period, charge_type, CAST(sum(CAST(allocated_amount AS DECIMAL(18,4))) AS DOUBLE) AS v
             FROM mart_charge_allocated GROUP BY 1, 2) a
    ON i.period = a.period AND i.charge_type = a.charge_type) x
