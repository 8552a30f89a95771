-- name: lots
SELECT x.*,
       CASE WHEN coalesce(final_expiry_date < snapshot_date, false) THEN onhand_qty ELSE 0.0 END AS expired_qty,
       CASE WHEN blocked THEN onhand_qty ELSE 0.0 END AS blocked_qty,
       greatest(onhand_qty
         - CASE WHEN coalesce(final_expiry_date < snapshot_date, false) THEN onhand_qty ELSE 0.0 END
         - CASE WHEN blocked THEN onhand_qty ELSE 0.0 END, 0.0) AS sellable_qty
FROM (
  SELECT y.*,
         coalesce(hold_flag, false)
         OR (coalesce(qc_required_flag, false) AND lower(coalesce(qc_status, '')) <> 'released')
         OR coalesce(final_expiry_date >= snapshot_date
                     AND final_expiry_date < snapshot_date + effective_min_sellable_days, false) AS blocked
  FROM (
    SELECT s.*, i.item_type, i.qc_required_flag,
           coalesce(s.expiry_date, m.mfg + i.shelf_life_days) AS final_expiry_date,
           CAST(coalesce(i.min_sellable_days,
             CASE i.item_type WHEN 'RM' THEN 30 WHEN 'PM' THEN 90 WHEN 'FG' THEN 60 ELSE 60 END) AS INTEGER)
             AS effective_min_sellable_days
    FROM fact_inventory_snapshot s
    LEFT JOIN dim_item i ON s.item_id = i.item_id
    LEFT JOIN (SELECT item_id, lot_id, min(mfg_date) AS mfg FROM fact_receipt
               WHERE mfg_date IS NOT NULL GROUP BY 1, 2) m
      ON s.item_id = m.item_id AND s.lot_id = m.lot_id) y) x

-- name: lots_ranked
SELECT *,
       CASE WHEN final_expiry_date IS NOT NULL THEN CAST(row_number() OVER (
         PARTITION BY warehouse_id, item_id
         ORDER BY final_expiry_date NULLS LAST, snapshot_date, lot_id) AS INTEGER) END AS fefo_rank,
       CAST(final_expiry_date - snapshot_date AS INTEGER) AS days_to_expiry,
       CASE WHEN final_expiry_date IS NULL THEN 'N/A'
            WHEN final_expiry_date - snapshot_date < 0 THEN 'EXPIRED'
            WHEN final_expiry_date - snapshot_date < 30 THEN '0-30d'
            WHEN final_expiry_date - snapshot_date < 60 THEN '30-60d'
            WHEN final_expiry_date - snapshot_date < 90 THEN '60-90d'
            WHEN final_expiry_date - snapshot_date < 180 THEN '90-180d'
            WHEN final_expiry_date - snapshot_date < 365 THEN '180-365d'
            ELSE '>365d' END AS expiry_bucket
FROM lots

-- name: final_expiry
SELECT snapshot_date, warehouse_id, item_id, lot_id, onhand_qty, item_type, final_expiry_date,
       effective_min_sellable_days
FROM lots

-- name: sellable_qty
SELECT snapshot_date, warehouse_id, item_id, lot_id, onhand_qty, expired_qty, blocked_qty, sellable_qty FROM lots

-- name: fefo_rank
SELECT snapshot_date, warehouse_id, item_id, lot_id, final_expiry_date, fefo_rank FROM lots_ranked

-- name: expiry_bucket
SELECT snapshot_date, warehouse_id, item_id, lot_id, days_to_expiry, expiry_bucket FROM lots_ranked

-- name: expired_issues
SELECT sha256('EXPIRED_STOCK|' || item_id || '|' || lot_id || '|' || warehouse_id || '|' || snapshot_date)[1:12]
         AS issue_id,
       'EXPIRED_STOCK' AS issue_type, 'CRITICAL' AS severity, 'expiry' AS domain, 'item_lot' AS entity_type,
       item_id || '|' || lot_id || '|' || warehouse_id AS entity_id,
       CAST(snapshot_date AS VARCHAR) AS period,
       'Expired stock: item=' || item_id || ', lot=' || lot_id || ', warehouse=' || warehouse_id || ', qty='
         || CAST(expired_qty AS BIGINT) || ', expiry=' || final_expiry_date AS detail
FROM lots WHERE expired_qty > 0

-- name: mart_inventory_onhand
SELECT snapshot_date, warehouse_id, item_id, lot_id, onhand_qty, sellable_qty, blocked_qty, expired_qty,
       final_expiry_date, expiry_bucket, fefo_rank, effective_min_sellable_days AS min_sellable_days
FROM lots_ranked

-- name: mart_open_po
SELECT p.po_id, p.item_id, supplier_id, po_date, eta_date, first_receipt_date, qty_ordered,
       coalesce(r.qty, 0.0) AS qty_received,
       greatest(qty_ordered - coalesce(r.qty, 0.0), 0.0) AS qty_open,
       CAST(CASE WHEN eta_date < DATE '2002-01-01' THEN DATE '2002-01-01' - eta_date ELSE 0 END AS INTEGER) AS delay_days,
       CAST(first_receipt_date - po_date AS INTEGER) AS po_lead_days,
       CAST(first_receipt_date - eta_date AS INTEGER) AS eta_vs_actual_days,
       strftime(po_date, '%Y-%m') AS period
FROM fact_po p
LEFT JOIN (SELECT po_id, item_id, CAST(sum(CAST(qty_received AS DECIMAL(18,4))) AS DOUBLE) AS qty,
                  min(receipt_date) AS first_receipt_date
           FROM fact_receipt WHERE po_id IS NOT NULL GROUP BY 1, 2) r
  ON p.po_id = r.po_id AND p.item_id = r.item_id

-- name: daily_demand
SELECT warehouse_id, item_id,
       CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE)
         / greatest(max(ship_date) - min(ship_date) + 1, 1) AS avg_daily_demand
FROM fact_shipment WHERE channel_order_id IS NOT NULL GROUP BY 1, 2

-- name: latest_stock
SELECT l.warehouse_id, l.item_id, item_type, m.d AS as_of_date,
       CAST(sum(CAST(onhand_qty AS DECIMAL(18,4))) AS DOUBLE) AS onhand_qty,
       CAST(sum(CAST(sellable_qty AS DECIMAL(18,4))) AS DOUBLE) AS sellable_qty
FROM lots l
JOIN (SELECT warehouse_id, item_id, max(snapshot_date) AS d FROM fact_inventory_snapshot GROUP BY 1, 2) m
  ON l.warehouse_id = m.warehouse_id AND l.item_id = m.item_id AND l.snapshot_date = m.d
GROUP BY 1, 2, 3, 4

-- name: mart_stockout_risk
SELECT *, days_of_cover < threshold_days AS risk_flag
FROM (
  SELECT s.item_id, s.warehouse_id, sellable_qty, coalesce(d.avg_daily_demand, 0.0) AS avg_daily_demand,
         CASE WHEN d.avg_daily_demand > 0 THEN sellable_qty / d.avg_daily_demand
              ELSE 'infinity'::DOUBLE END AS days_of_cover,
         7 AS threshold_days, as_of_date
  FROM latest_stock s
  LEFT JOIN daily_demand d ON s.warehouse_id = d.warehouse_id AND s.item_id = d.item_id) x

-- name: mart_overstock
SELECT *, CASE WHEN overstock_flag THEN greatest(onhand_qty - avg_daily_demand * doh_threshold, 0.0) ELSE 0.0 END
            AS overstock_qty
FROM (
  SELECT *, days_on_hand > doh_threshold AS overstock_flag
  FROM (
    SELECT s.item_id, s.warehouse_id, coalesce(item_type, 'FG') AS item_type, onhand_qty,
           coalesce(d.avg_daily_demand, 0.0) AS avg_daily_demand,
           CASE WHEN d.avg_daily_demand > 0 THEN onhand_qty / d.avg_daily_demand
                ELSE 'infinity'::DOUBLE END AS days_on_hand,
           CASE coalesce(item_type, 'FG') WHEN 'RM' THEN 120 WHEN 'PM' THEN 180 ELSE 90 END AS doh_threshold,
           as_of_date
    FROM latest_stock s
    LEFT JOIN daily_demand d ON s.warehouse_id = d.warehouse_id AND s.item_id = d.item_id) a) b

-- name: unit_cost
SELECT item_id, effective_from, CAST(sum(CAST(cost_per_unit_krw AS DECIMAL(18,4))) AS DOUBLE) AS unit_cost_krw
FROM fact_cost_structure GROUP BY 1, 2

-- name: mart_expiry_risk
SELECT l.item_id, warehouse_id, lot_id, onhand_qty, final_expiry_date, days_to_expiry, expiry_bucket,
       onhand_qty * c.unit_cost_krw AS risk_value_krw, snapshot_date AS as_of_date
FROM (SELECT * FROM lots_ranked WHERE final_expiry_date IS NOT NULL) l
ASOF LEFT JOIN unit_cost c ON l.item_id = c.item_id AND l.snapshot_date >= c.effective_from

-- name: mart_fefo_pick_list
SELECT warehouse_id, item_id, lot_id, onhand_qty, sellable_qty, final_expiry_date, fefo_rank, snapshot_date
FROM lots_ranked

-- name: mart_service_level
SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start, channel_store_id,
       count(*) AS total_orders,
       count(*) FILTER (WHERE f <= order_date + 3) AS shipped_on_time,
       count(*) FILTER (WHERE f <= order_date + 3) / count(*) AS service_level_pct
FROM fact_order o
LEFT JOIN (SELECT channel_order_id AS id, min(ship_date) AS f FROM fact_shipment GROUP BY 1) s
  ON o.channel_order_id = s.id
GROUP BY 1, 2

-- name: mart_shipment_performance
SELECT *, on_time_count / total_shipments AS on_time_pct
FROM (
  SELECT strftime(ship_date, '%Y-%m') AS period, warehouse_id, channel_store_id,
         count(DISTINCT shipment_id) AS total_shipments,
         CAST(coalesce(sum(CAST(qty_shipped AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_qty_shipped,
         CAST(coalesce(sum(CAST(weight AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_weight,
         CAST(coalesce(sum(CAST(volume_cbm AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_volume_cbm,
         CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) / count(qty_shipped) AS avg_qty_per_shipment,
         CAST(sum(ship_date - d) AS DOUBLE) / nullif(count(ship_date - d), 0) AS avg_lead_days,
         count(*) FILTER (WHERE ship_date <= d + 3) AS on_time_count
  FROM fact_shipment s
  LEFT JOIN (SELECT channel_order_id AS id, min(order_date) AS d FROM fact_order GROUP BY 1) o
    ON s.channel_order_id = o.id
  GROUP BY 1, 2, 3) x

-- name: mart_shipment_daily
SELECT ship_date, warehouse_id, count(DISTINCT shipment_id) AS shipment_count,
       CAST(coalesce(sum(CAST(qty_shipped AS DECIMAL(18,4))), 0) AS DOUBLE) AS qty_shipped,
       CAST(coalesce(sum(CAST(weight AS DECIMAL(18,4))), 0) AS DOUBLE) AS weight,
       CAST(coalesce(sum(CAST(volume_cbm AS DECIMAL(18,4))), 0) AS DOUBLE) AS volume_cbm,
       count(DISTINCT channel_order_id) + CAST(bool_or(channel_order_id IS NULL) AS BIGINT) AS unique_orders,
       count(DISTINCT item_id) AS unique_items
FROM fact_shipment GROUP BY 1, 2

-- name: shipped_monthly
SELECT strftime(ship_date, '%Y-%m') AS period, item_id, warehouse_id,
       CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS qty_shipped
FROM fact_shipment GROUP BY 1, 2, 3

-- name: mart_return_analysis
SELECT a.*, m.qty_shipped,
       CASE WHEN m.qty_shipped > 0 THEN a.qty_returned / m.qty_shipped ELSE 0.0 END AS return_rate
FROM (
  SELECT strftime(return_date, '%Y-%m') AS period, item_id, warehouse_id, o.channel_store_id, reason, disposition,
         count(DISTINCT return_id) AS return_count,
         CAST(coalesce(sum(CAST(qty_returned AS DECIMAL(18,4))), 0) AS DOUBLE) AS qty_returned
  FROM fact_return r
  LEFT JOIN (SELECT DISTINCT channel_order_id, channel_store_id FROM fact_order) o
    ON r.channel_order_id = o.channel_order_id
  GROUP BY 1, 2, 3, 4, 5, 6) a
LEFT JOIN shipped_monthly m
  ON a.period = m.period AND a.item_id = m.item_id AND a.warehouse_id = m.warehouse_id

-- name: mart_return_daily
SELECT d.*, t.reason AS top_reason
FROM (
  SELECT return_date, warehouse_id, count(DISTINCT return_id) AS return_count,
         CAST(coalesce(sum(CAST(qty_returned AS DECIMAL(18,4))), 0) AS DOUBLE) AS qty_returned,
         count(DISTINCT channel_order_id) + CAST(bool_or(channel_order_id IS NULL) AS BIGINT) AS unique_orders,
         count(DISTINCT item_id) AS unique_items
  FROM fact_return GROUP BY 1, 2) d
LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY return_date, warehouse_id ORDER BY n DESC, reason) AS rn
  FROM (SELECT return_date, warehouse_id, reason, count(*) AS n FROM fact_return
        WHERE reason IS NOT NULL GROUP BY 1, 2, 3) c) t
  ON d.return_date = t.return_date AND d.warehouse_id = t.warehouse_id AND t.rn = 1

-- name: mart_inventory_turnover
SELECT *, CASE WHEN turnover_ratio > 0 THEN 365.0::DOUBLE / turnover_ratio END AS days_on_hand
FROM (
  SELECT *, CASE WHEN avg_inventory > 0 THEN cogs_or_shipment / avg_inventory END AS turnover_ratio
  FROM (
    SELECT e.period, e.item_id, e.warehouse_id, (first_qty + last_qty) / 2 AS avg_inventory,
           coalesce(m.qty_shipped, 0.0) AS cogs_or_shipment
    FROM (
      SELECT strftime(snapshot_date, '%Y-%m') AS period, item_id, warehouse_id,
             arg_min(q, snapshot_date) AS first_qty, arg_max(q, snapshot_date) AS last_qty
      FROM (SELECT snapshot_date, item_id, warehouse_id,
                   CAST(sum(CAST(onhand_qty AS DECIMAL(18,4))) AS DOUBLE) AS q
            FROM fact_inventory_snapshot GROUP BY 1, 2, 3) d
      GROUP BY 1, 2, 3) e
    LEFT JOIN shipped_monthly m
      ON e.period = m.period AND e.item_id = m.item_id AND e.warehouse_id = m.warehouse_id) a) b

-- name: lead_time_analysis
SELECT period, supplier_id, item_id, count(*) AS total_count,
       CAST(sum(lead) AS DOUBLE) / count(*) AS avg_lead_days,
       CAST(min(lead) AS INTEGER) AS min_lead_days, CAST(max(lead) AS INTEGER) AS max_lead_days,
       quantile_cont(CAST(lead AS DOUBLE), 0.25) AS q1_lead_days,
       quantile_cont(CAST(lead AS DOUBLE), 0.5) AS median_lead_days,
       quantile_cont(CAST(lead AS DOUBLE), 0.75) AS q3_lead_days,
       CAST(sum(vs_eta) AS DOUBLE) / count(*) AS avg_eta_vs_actual,
       count(*) FILTER (WHERE vs_eta > 0) / count(*) AS late_po_ratio,
       CAST(sum(vs_eta) FILTER (WHERE vs_eta > 0) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE vs_eta > 0), 0) AS avg_delay_days
FROM (
  SELECT strftime(po_date, '%Y-%m') AS period, supplier_id, p.item_id, receipt_date - po_date AS lead,
         receipt_date - coalesce(eta_date, po_date + 14) AS vs_eta
  FROM fact_po p JOIN fact_receipt r ON p.po_id = r.po_id AND p.item_id = r.item_id) x
GROUP BY 1, 2, 3
