-- name: forecast_accuracy
SELECT *, greatest(1.0 - mape, 0.0) * 100 AS accuracy_pct
FROM (
  SELECT *, CASE WHEN actual_qty > 0 THEN abs_error / actual_qty END AS mape,
         CASE WHEN actual_qty > 0 THEN error_qty / actual_qty END AS bias
  FROM (
    SELECT period, item_id, warehouse_id, forecast_method, actual_qty, forecast_qty,
           forecast_qty - actual_qty AS error_qty, abs(forecast_qty - actual_qty) AS abs_error
    FROM (
      SELECT period, item_id, warehouse_id, qty_shipped AS actual_qty, forecast_method,
             CAST(CAST(qty_shipped * (CAST(CAST(item_id AS INTEGER) % 5 AS DOUBLE) * step + base) AS DECIMAL(18,4)) AS DOUBLE) AS forecast_qty
      FROM shipped_monthly, (VALUES ('NAIVE_AVG', 0.1::DOUBLE, 0.8::DOUBLE), ('PROPHET', 0.05::DOUBLE, 0.9::DOUBLE)) AS m(forecast_method, step, base)) a) b) c

-- name: method_monthly
SELECT period, warehouse_id, forecast_method,
       CAST(sum(CAST(mape AS DECIMAL(28,10))) AS DOUBLE) / count(mape) AS mape,
       CAST(sum(CAST(bias AS DECIMAL(28,10))) AS DOUBLE) / count(bias) AS bias
FROM forecast_accuracy GROUP BY 1, 2, 3

-- name: model_performance
SELECT *, rank_in_period = 1 AS is_champion,
       CASE WHEN mape < mape_prev_period * (1 - 0.05::DOUBLE) THEN 'IMPROVING' WHEN mape > mape_prev_period * (1 + 0.05::DOUBLE) THEN 'DEGRADING'
            WHEN mape_prev_period IS NOT NULL THEN 'STABLE' END AS mape_trend,
       coalesce(mape - mape_prev_period > 0.02, false) AS drift_detected
FROM (
  SELECT m.*, p.mape AS mape_prev_period,
         CAST(row_number() OVER (PARTITION BY m.period, m.warehouse_id ORDER BY m.mape, m.forecast_method) AS INTEGER) AS rank_in_period
  FROM method_monthly m
  LEFT JOIN method_monthly p
    ON m.period = strftime(CAST(p.period || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')
   AND m.warehouse_id = p.warehouse_id AND m.forecast_method = p.forecast_method) t

-- name: lead_time_vs_prediction
SELECT *, CAST(CAST(supplier_id AS INTEGER) % 5 + 18 AS DOUBLE) AS predicted_lead_days_avg,
       actual_lead_days_avg - CAST(CAST(supplier_id AS INTEGER) % 5 + 18 AS DOUBLE) AS prediction_error_days
FROM (
  SELECT strftime(po_date, '%Y-%m') AS period, supplier_id,
         CAST(sum(receipt_date - po_date) AS DOUBLE) / count(*) AS actual_lead_days_avg,
         quantile_cont(CAST(receipt_date - po_date AS DOUBLE), 0.5) AS actual_lead_days_p50,
         quantile_cont(CAST(receipt_date - po_date AS DOUBLE), 0.9) AS actual_lead_days_p90,
         count(*) FILTER (WHERE receipt_date > eta_date) / count(*) AS late_po_ratio, count(*) AS total_po_count
  FROM fact_po p JOIN fact_receipt r ON p.po_id = r.po_id AND p.item_id = r.item_id GROUP BY 1, 2) t

-- name: kpi_forecast
SELECT a.*, p.*, l.*
FROM (SELECT CAST(sum(CAST(accuracy_pct AS DECIMAL(28,10))) AS DOUBLE) / count(accuracy_pct) AS avg_accuracy FROM forecast_accuracy) a,
     (SELECT count(*) AS urgent_orders,
             CAST(coalesce(sum(CAST(greatest(avg_daily_demand * threshold_days - sellable_qty, 0.0) AS DECIMAL(18,4))), 0) AS DOUBLE) AS recommended_qty
      FROM mart_stockout_risk WHERE risk_flag) p,
     (SELECT CAST(sum(CAST(abs(prediction_error_days) AS DECIMAL(28,10))) AS DOUBLE) / count(prediction_error_days) AS avg_lead_error
      FROM lead_time_vs_prediction) l

-- name: abc_classification
SELECT period, item_id, revenue_krw, cumulative_pct,
       CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS abc_grade
FROM (
  SELECT period, item_id, CAST(v AS DOUBLE) AS revenue_krw,
         CAST(sum(v) OVER (PARTITION BY period ORDER BY v DESC, item_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100
           / CAST(sum(v) OVER (PARTITION BY period) AS DOUBLE) AS cumulative_pct
  FROM (SELECT period, item_id, sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS v FROM mart_pnl_revenue
        WHERE net_revenue_krw IS NOT NULL GROUP BY 1, 2) a) b

-- name: supplier_scorecard
SELECT *, on_time_rate * 40 + least(coalesce(fill_rate, 0.0), 1.0) * 30
          + greatest(1.0 - coalesce(lead_time_stddev, 0.0) / 10.0::DOUBLE, 0.0) * 30 AS overall_score
FROM (
  SELECT period, supplier_id, total_po_count, on_time_count, on_time_count / total_po_count AS on_time_rate,
         CAST(s AS DOUBLE) / nullif(n, 0) AS avg_lead_days,
         CASE WHEN n > 1 THEN sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END AS lead_time_stddev,
         qty_ordered, qty_received, CASE WHEN qty_ordered > 0 THEN qty_received / qty_ordered END AS fill_rate
  FROM (
    SELECT strftime(po_date, '%Y-%m') AS period, supplier_id, count(*) AS total_po_count,
           count(*) FILTER (WHERE f <= eta_date) AS on_time_count, count(f) AS n,
           CAST(sum(f - po_date) AS BIGINT) AS s, CAST(sum((f - po_date) * (f - po_date)) AS BIGINT) AS ss,
           sum(qty_ordered) AS qty_ordered, coalesce(sum(got), 0.0) AS qty_received
    FROM fact_po p
    LEFT JOIN (SELECT po_id, item_id, sum(qty_received) AS got, min(receipt_date) AS f FROM fact_receipt GROUP BY 1, 2) r
      ON p.po_id = r.po_id AND p.item_id = r.item_id
    GROUP BY 1, 2) a) b

-- name: channel_profitability
SELECT g.*, c.variable_cost_krw, c.contribution_krw,
       CASE WHEN net_revenue_krw > 0 THEN contribution_krw / net_revenue_krw END AS contribution_pct
FROM (SELECT period, channel_store_id, CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS net_revenue_krw,
             CAST(sum(CAST(cogs_krw AS DECIMAL(18,4))) AS DOUBLE) AS cogs_krw,
             CAST(sum(CAST(gross_margin_krw AS DECIMAL(18,4))) AS DOUBLE) AS gross_margin_krw
      FROM mart_pnl_gross_margin GROUP BY 1, 2) g
LEFT JOIN (SELECT period, channel_store_id, CAST(sum(CAST(total_variable_cost_krw AS DECIMAL(18,4))) AS DOUBLE) AS variable_cost_krw,
                  CAST(sum(CAST(contribution_krw AS DECIMAL(18,4))) AS DOUBLE) AS contribution_krw
           FROM mart_pnl_contribution GROUP BY 1, 2) c
  ON g.period = c.period AND g.channel_store_id = c.channel_store_id

-- name: grain_sums
SELECT 'month' AS grain, CAST(date_trunc('month', ship_date) AS DATE) AS bucket, channel_store_id, sum(qty_shipped) AS q, 1 AS months
FROM fact_shipment GROUP BY 2, 3
UNION ALL
SELECT 'quarter', CAST(date_trunc('quarter', ship_date) AS DATE), channel_store_id, sum(qty_shipped), 3 FROM fact_shipment GROUP BY 2, 3
UNION ALL
SELECT 'year', CAST(date_trunc('year', ship_date) AS DATE), channel_store_id, sum(qty_shipped), 12 FROM fact_shipment GROUP BY 2, 3

-- name: period_comparison
SELECT n.grain, n.bucket, n.channel_store_id, n.q AS current_qty, p.q AS previous_qty, n.q - p.q AS change_qty,
       CASE WHEN p.q > 0 THEN (n.q - p.q) * 100 / p.q END AS change_pct
FROM grain_sums n
LEFT JOIN (SELECT grain, CAST(bucket + to_months(CAST(months AS INTEGER)) AS DATE) AS next_bucket, channel_store_id, q FROM grain_sums) p
  ON n.grain = p.grain AND n.channel_store_id = p.channel_store_id AND n.bucket = p.next_bucket

-- name: filter_options
SELECT DISTINCT 'warehouse_id' AS kind, warehouse_id AS value FROM fact_shipment
UNION ALL SELECT DISTINCT 'item_id', item_id FROM fact_shipment
UNION ALL SELECT DISTINCT 'channel_store_id', channel_store_id FROM fact_shipment

-- name: custom_report
SELECT period, channel_store_id, CAST(count(*) OVER (PARTITION BY period, channel_store_id) AS INTEGER) AS warehouses, warehouse_id, qty, mean
FROM (SELECT strftime(ship_date, '%Y-%m') AS period, channel_store_id, warehouse_id, sum(qty_shipped) AS qty, avg(qty_shipped) AS mean
      FROM fact_shipment GROUP BY 1, 2, 3) s

-- name: dq_report_summary
SELECT file_name, severity, count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks
FROM dq_report GROUP BY 1, 2

-- name: alert_dedup
SELECT k.event_type, k.user_id, min(e.event_id) FILTER (WHERE e.ts = k.ts) AS event_id, k.ts, count(*) AS signals
FROM (WITH RECURSIVE chain AS (
        SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2
        UNION ALL
        SELECT c.event_type, c.user_id, min(e.ts)
        FROM chain c JOIN events e ON e.event_type = c.event_type AND e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 24 HOUR
        GROUP BY c.event_type, c.user_id)
      SELECT *, lead(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS following FROM chain) k
JOIN events e ON e.event_type = k.event_type AND e.user_id = k.user_id AND e.ts >= k.ts AND (k.following IS NULL OR e.ts < k.following)
GROUP BY k.event_type, k.user_id, k.ts

-- name: alert_dedup_signals
SELECT metric_name, entity_type, entity_id, min(period) AS period, detected_at, count(*) AS signals
FROM (SELECT metric_name, entity_type, entity_id, period, detected_at FROM mart_anomaly_signals
      UNION ALL SELECT metric_name, entity_type, entity_id, period, detected_at FROM mart_constraint_signals) s
GROUP BY 1, 2, 3, 5

