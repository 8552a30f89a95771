-- name: scm_filter
SELECT * FROM mart_shipment_daily
WHERE ship_date >= DATE '1998-01-15' AND ship_date < DATE '1998-04-21' AND warehouse_id = 'W1'

-- name: scm_filter_periods
SELECT * FROM mart_open_po WHERE period BETWEEN '1998-01' AND '1998-04' AND supplier_id = '7'

-- name: pnl_filter
SELECT * FROM mart_pnl_revenue
WHERE period BETWEEN '1998-01' AND '1998-04' AND channel_store_id = 'S3' AND country = 'KR'

-- name: time_bucket
SELECT CAST(order_date AS VARCHAR) AS day,
       strftime(order_date, '%Y') || '-W' || lpad(CAST(CAST(floor((dayofyear(order_date) - 1
         + dayofweek(date_trunc('year', order_date))) / 7) AS BIGINT) + 1 AS VARCHAR), 2, '0') AS week,
       strftime(order_date, '%Y-%m') AS month, strftime(order_date, '%Y') AS year, count(*) AS lines
FROM fact_order GROUP BY order_date

-- name: time_grain
SELECT item_id, CAST(d AS INTEGER) AS days,
       CASE WHEN d <= 31 THEN 'day' WHEN d <= 120 THEN 'week' WHEN d <= 730 THEN 'month' ELSE 'year' END AS grain
FROM (SELECT item_id, max(order_date) - min(order_date) + 1 AS d FROM fact_order GROUP BY 1) t

-- name: result_coverage
SELECT input, count(*) AS row_count,
       CASE WHEN bool_and(coalesce(coverage_flag = 'ACTUAL', true)) THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
FROM (
  SELECT 'mart_shipment_daily' AS input, NULL AS coverage_flag FROM mart_shipment_daily
  WHERE ship_date BETWEEN DATE '1998-01-15' AND DATE '1998-04-20'
  UNION ALL SELECT 'mart_pnl_revenue', coverage_flag FROM mart_pnl_revenue WHERE period BETWEEN '1998-01' AND '1998-04'
  UNION ALL SELECT 'mart_pnl_cogs', coverage_flag FROM mart_pnl_cogs WHERE period BETWEEN '1998-01' AND '1998-04'
  UNION ALL SELECT 'mart_pnl_gross_margin', coverage_flag FROM mart_pnl_gross_margin WHERE period BETWEEN '1998-01' AND '1998-04') t
GROUP BY 1

-- name: missing_input_notices
SELECT input, CASE WHEN state = 'NO_DATA' THEN none ELSE part END AS notice,
       CASE WHEN state = 'NO_DATA' THEN tone ELSE 'warning' END AS tone
FROM (
  SELECT 'mart_inventory_onhand' AS input, 'inventory' AS none, 'inventory-partial' AS part, 'critical' AS tone,
         CASE WHEN count(*) = 0 THEN 'NO_DATA' ELSE 'ACTUAL' END AS state
  FROM fact_inventory_snapshot WHERE snapshot_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31'
  UNION ALL
  SELECT 'mart_open_po', 'po', NULL, 'info', CASE WHEN count(*) = 0 THEN 'NO_DATA' ELSE 'ACTUAL' END
  FROM mart_open_po WHERE period BETWEEN '2001-10' AND '2001-12' AND qty_open > 0
  UNION ALL
  SELECT 'mart_shipment_daily', 'shipment', NULL, 'warning', CASE WHEN count(*) = 0 THEN 'NO_DATA' ELSE 'ACTUAL' END
  FROM fact_shipment WHERE ship_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31'
  UNION ALL
  SELECT 'mart_return_analysis', 'return', NULL, 'info', CASE WHEN count(*) = 0 THEN 'NO_DATA' ELSE 'ACTUAL' END
  FROM fact_return WHERE strftime(return_date, '%Y-%m') BETWEEN '2001-10' AND '2001-12'
  UNION ALL
  SELECT 'mart_pnl_revenue', 'sales', 'sales-partial', 'critical',
         CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN bool_and(coverage_flag = 'ACTUAL') THEN 'ACTUAL' ELSE 'PARTIAL' END
  FROM mart_pnl_revenue WHERE period BETWEEN '2001-10' AND '2001-12'
  UNION ALL
  SELECT 'mart_pnl_cogs', 'cogs', 'cogs-partial', 'critical',
         CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN bool_and(coverage_flag = 'ACTUAL') THEN 'ACTUAL' ELSE 'PARTIAL' END
  FROM mart_pnl_cogs WHERE period BETWEEN '2001-10' AND '2001-12'
  UNION ALL
  SELECT 'mart_pnl_contribution', 'charge', 'charge-partial', 'warning',
         CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN bool_and(coverage_flag = 'ACTUAL') THEN 'ACTUAL' ELSE 'PARTIAL' END
  FROM mart_pnl_contribution WHERE period BETWEEN '2001-10' AND '2001-12') t
WHERE state = 'NO_DATA' OR (state = 'PARTIAL' AND part IS NOT NULL)

-- name: kpi_inventory_summary
SELECT snapshot_date, warehouse_id, item_id, sum(onhand_qty) AS onhand_qty, sum(sellable_qty) AS sellable_qty,
       sum(blocked_qty) AS blocked_qty, sum(expired_qty) AS expired_qty, count(*) AS lot_count
FROM lots GROUP BY 1, 2, 3

-- name: kpi_inventory
SELECT sum(onhand_qty) AS total_onhand, sum(sellable_qty) AS total_sellable, sum(blocked_qty) AS total_blocked,
       sum(expired_qty) AS total_expired, count(DISTINCT warehouse_id || '|' || item_id) AS unique_items,
       CAST(sum(lot_count) AS DOUBLE) / count(*) AS avg_lots_per_item,
       sum(sellable_qty) * 100 / sum(onhand_qty) AS sellable_rate
FROM kpi_inventory_summary

-- name: kpi_inventory_by_warehouse
SELECT warehouse_id, sum(sellable_qty) AS sellable, sum(blocked_qty) AS blocked, sum(expired_qty) AS expired
FROM lots GROUP BY 1

-- name: kpi_turnover
SELECT CAST(sum(CAST(turnover_ratio AS DECIMAL(28,10))) AS DOUBLE) / count(turnover_ratio) AS avg_turnover,
       CAST(sum(CAST(days_on_hand AS DECIMAL(28,10))) AS DOUBLE) / count(days_on_hand) AS avg_days_on_hand,
       count(*) FILTER (WHERE days_on_hand > 90) AS slow_movers, count(DISTINCT item_id) AS total_items
FROM mart_inventory_turnover

-- name: kpi_turnover_trend
SELECT period, floor(CAST(sum(CAST(turnover_ratio AS DECIMAL(28,10))) AS DOUBLE) / count(turnover_ratio) * 100 + 0.5::DOUBLE) / 100
         AS turnover_ratio
FROM mart_inventory_turnover WHERE turnover_ratio IS NOT NULL GROUP BY 1

-- name: kpi_turnover_ranking
SELECT * FROM mart_inventory_turnover WHERE turnover_ratio IS NOT NULL

-- name: kpi_stockout
SELECT count(*) FILTER (WHERE sellable_qty <= 0) AS stockout_count,
       count(*) FILTER (WHERE risk_flag AND sellable_qty > 0) AS risk_count,
       CAST(sum(CAST(c AS DECIMAL(28,10))) AS DOUBLE) / count(c) AS avg_days_of_cover,
       count(*) FILTER (WHERE days_of_cover <= threshold_days) AS at_or_below_threshold,
       CAST(sum(CAST(c - threshold_days AS DECIMAL(28,10))) AS DOUBLE) / count(c) AS avg_gap_to_threshold
FROM (SELECT *, CASE WHEN avg_daily_demand > 0 THEN days_of_cover END AS c FROM mart_stockout_risk) t

-- name: kpi_stockout_lowest
SELECT item_id, warehouse_id, days_of_cover, threshold_days FROM mart_stockout_risk
ORDER BY days_of_cover, item_id, warehouse_id LIMIT 20

-- name: kpi_open_po_rows
SELECT po_id, item_id, eta_date, qty_open, delay_days,
       CASE WHEN delay_days > 0 THEN 'late' WHEN first_receipt_date IS NOT NULL THEN 'partly received' ELSE 'in progress' END AS status
FROM mart_open_po WHERE qty_open > 0

-- name: kpi_open_po
SELECT count(*) AS open_count, sum(qty_open) AS open_qty, count(*) FILTER (WHERE delay_days > 0) AS delayed_count,
       sum(qty_open) FILTER (WHERE delay_days > 0) AS overdue_qty,
       CAST(sum(po_lead_days) AS DOUBLE) / count(po_lead_days) AS avg_lead_days,
       count(first_receipt_date) AS partial_receipt_count
FROM mart_open_po WHERE qty_open > 0

-- name: kpi_lead_time
SELECT count(DISTINCT supplier_id) AS supplier_count, CAST(sum(total_count) AS BIGINT) AS total_samples,
       CAST(sum(CAST(avg_lead_days * total_count AS DECIMAL(28,10))) AS DOUBLE) / sum(total_count) AS avg_lead_days,
       CAST(sum(CAST(median_lead_days * total_count AS DECIMAL(28,10))) AS DOUBLE) / sum(total_count) AS median_lead_days,
       CAST(sum(CAST(avg_delay_days * total_count AS DECIMAL(28,10))) AS DOUBLE)
         / sum(total_count) FILTER (WHERE avg_delay_days IS NOT NULL) AS avg_delay_days,
       CAST(sum(CAST(late_po_ratio * total_count AS DECIMAL(28,10))) AS DOUBLE) / sum(total_count) AS late_po_ratio
FROM lead_time_analysis

-- name: kpi_lead_time_top
SELECT period, supplier_id, item_id, total_count, avg_lead_days, avg_delay_days FROM lead_time_analysis
ORDER BY total_count DESC, supplier_id, item_id, period LIMIT 8

-- name: kpi_shipment_return
SELECT s.*, returned_qty, return_count, returned_qty / basis AS return_rate
FROM (SELECT sum(qty_shipped) AS shipped_qty, CAST(sum(shipment_count) AS BIGINT) AS shipment_count,
             sum(qty_shipped) / count(*) AS avg_daily_shipment FROM mart_shipment_daily) s,
     (SELECT sum(qty_returned) AS returned_qty, CAST(sum(return_count) AS BIGINT) AS return_count,
             sum(qty_shipped) AS basis FROM mart_return_analysis) r

-- name: kpi_shipment_trend
SELECT strftime(ship_date, '%Y') || '-W' || lpad(CAST(CAST(floor((dayofyear(ship_date) - 1
         + dayofweek(date_trunc('year', ship_date))) / 7) AS BIGINT) + 1 AS VARCHAR), 2, '0') AS week,
       sum(qty_shipped) AS shipped_qty
FROM mart_shipment_daily GROUP BY 1

-- name: kpi_return_reasons
SELECT coalesce(reason, 'unclassified') AS reason, sum(qty_returned) AS qty_returned,
       CAST(sum(return_count) AS BIGINT) AS return_count, coalesce(sum(qty_shipped), 0.0) AS qty_shipped,
       CASE WHEN sum(qty_shipped) > 0 THEN sum(qty_returned) / sum(qty_shipped) END AS return_rate
FROM mart_return_analysis GROUP BY 1

-- name: kpi_constraints
SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
       count(*) FILTER (WHERE severity = 'WARN') AS warn, count(DISTINCT domain) AS domains
FROM signals

-- name: kpi_scm_overview
SELECT a.*, b.*, c.*, d.*, returned * 100 / shipped_qty AS return_rate
FROM (SELECT sum(sellable_qty) AS total_sellable, sum(blocked_qty) AS total_blocked FROM lots) a,
     (SELECT count(*) FILTER (WHERE sellable_qty <= 0 OR risk_flag) AS risky_items,
             count(*) FILTER (WHERE days_of_cover <= threshold_days) AS at_or_below_threshold FROM mart_stockout_risk) b,
     (SELECT sum(qty_open) AS open_po_qty, count(*) FILTER (WHERE delay_days > 0) AS delayed_po_count
      FROM mart_open_po WHERE qty_open > 0) c,
     (SELECT sum(qty_shipped) AS shipped_qty, CAST(sum(shipment_count) AS BIGINT) AS shipment_count,
             sum(qty_shipped) / count(*) AS avg_daily_shipment FROM mart_shipment_daily) d,
     (SELECT sum(qty_returned) AS returned FROM mart_return_analysis) e

-- name: kpi_revenue
SELECT *, net_revenue * 100 / gross_sales AS net_rate
FROM (
  SELECT CAST(sum(CAST(gross_sales_krw AS DECIMAL(18,4))) AS DOUBLE) AS gross_sales,
         CAST(sum(CAST(discounts_krw AS DECIMAL(18,4))) AS DOUBLE) AS discounts,
         CAST(sum(CAST(refunds_krw AS DECIMAL(18,4))) AS DOUBLE) AS refunds,
         CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS net_revenue,
         count(DISTINCT channel_store_id) AS channels, count(DISTINCT country) AS countries
  FROM mart_pnl_revenue) t

-- name: kpi_revenue_trend
SELECT period, CAST(sum(v) OVER (PARTITION BY period) AS DOUBLE) AS month_revenue_krw, channel, CAST(v AS DOUBLE) AS net_revenue_krw
FROM (SELECT period, coalesce(channel_store_id, 'UNKNOWN') AS channel, sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS v
      FROM mart_pnl_revenue WHERE net_revenue_krw IS NOT NULL GROUP BY 1, 2) t

-- name: kpi_revenue_by_country
SELECT country, CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS net_revenue_krw,
       bool_or(coverage_flag <> 'ACTUAL') AS partial
FROM mart_pnl_revenue GROUP BY 1

-- name: kpi_cogs
SELECT sum(qty_net) AS qty_net,
       CAST(sum(CAST(unit_cost_krw AS DECIMAL(28,10))) AS DOUBLE) / count(unit_cost_krw) AS avg_unit_cost,
       CAST(sum(CAST(cogs_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_cogs,
       count(*) FILTER (WHERE coverage_flag <> 'ACTUAL') AS partial_rows,
       sum(qty_returned) * 100 / sum(qty_shipped) AS return_rate
FROM mart_pnl_cogs

-- name: kpi_contribution
SELECT CAST(sum(CAST(contribution_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_contribution,
       CAST(sum(CAST(total_variable_cost_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_variable_cost,
       count(*) FILTER (WHERE contribution_krw > 0) AS positive_rows,
       count(*) FILTER (WHERE contribution_krw < 0) AS negative_rows,
       CAST(sum(CAST(contribution_pct AS DECIMAL(28,10))) AS DOUBLE) / count(contribution_pct) AS avg_contribution_pct,
       count(*) FILTER (WHERE coverage_flag <> 'ACTUAL') AS partial_rows
FROM mart_pnl_contribution

-- name: kpi_contribution_by_channel
SELECT channel_store_id AS channel, CAST(sum(CAST(contribution_krw AS DECIMAL(18,4))) AS DOUBLE) AS contribution,
       CAST(sum(CAST(total_variable_cost_krw AS DECIMAL(18,4))) AS DOUBLE) AS variable_cost
FROM mart_pnl_contribution GROUP BY 1

-- name: kpi_operating_profit
SELECT *, CAST(partial_rows AS DOUBLE) / rows AS partial_share
FROM (
  SELECT CAST(sum(CAST(operating_profit_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_profit,
         count(*) FILTER (WHERE coverage_flag <> 'ACTUAL') AS partial_rows, count(*) AS rows,
         count(*) FILTER (WHERE operating_profit_krw > 0) AS profitable_rows,
         count(*) FILTER (WHERE operating_profit_krw < 0) AS loss_rows,
         CAST(sum(CAST(operating_profit_pct AS DECIMAL(28,10))) AS DOUBLE) / count(operating_profit_pct) AS avg_margin
  FROM mart_pnl_operating_profit) t

-- name: kpi_operating_profit_trend
SELECT period[1:4] AS year, CAST(sum(CAST(operating_profit_krw AS DECIMAL(18,4))) AS DOUBLE) AS operating_profit
FROM mart_pnl_operating_profit GROUP BY 1

-- name: kpi_profitability_top
SELECT period, item_id, channel_store_id, contribution_krw, rank_by_contribution FROM profitability_ranking
ORDER BY rank_by_contribution, period LIMIT 10

-- name: kpi_profitability
SELECT top_item, top_ten_contribution, r.*
FROM (SELECT arg_min(item_id, rank_by_contribution * 1000000 + CAST(replace(period, '-', '') AS BIGINT)) AS top_item,
             CAST(sum(CAST(contribution_krw AS DECIMAL(18,4))) AS DOUBLE) AS top_ten_contribution
      FROM kpi_profitability_top) t,
     (SELECT CAST(sum(CAST(contribution_pct AS DECIMAL(28,10))) AS DOUBLE) / count(contribution_pct) AS avg_contribution_pct,
             CAST(sum(CAST(gross_margin_pct AS DECIMAL(28,10))) AS DOUBLE) / count(gross_margin_pct) AS avg_gross_margin_pct,
             count(*) FILTER (WHERE contribution_krw > 0) AS profitable_rows, count(*) AS rows
      FROM profitability_ranking) r

-- name: kpi_pnl_overview
SELECT net_revenue, discount_and_refund, total_cogs, total_contribution, total_profit, loss_rows,
       total_profit * 100 / net_revenue AS operating_margin
FROM (SELECT CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS net_revenue,
             CAST(sum(CAST(coalesce(discounts_krw, 0.0) + coalesce(refunds_krw, 0.0) AS DECIMAL(18,4))) AS DOUBLE) AS discount_and_refund
      FROM mart_pnl_revenue) a,
     (SELECT CAST(sum(CAST(cogs_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_cogs FROM mart_pnl_cogs) b,
     (SELECT CAST(sum(CAST(contribution_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_contribution,
             CAST(sum(CAST(operating_profit_krw AS DECIMAL(18,4))) AS DOUBLE) AS total_profit,
             count(*) FILTER (WHERE operating_profit_krw < 0) AS loss_rows
      FROM mart_pnl_operating_profit) c

-- name: anomaly_banner
SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
       count(*) AS total
FROM mart_anomaly_signals

-- name: anomaly_banner_preview
SELECT severity, metric_name, entity_id, period FROM mart_anomaly_signals
ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END,
         round_even(abs(deviation), 6) DESC, metric_name, entity_id, period LIMIT 3
