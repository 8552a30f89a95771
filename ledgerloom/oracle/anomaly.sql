-- name: series
SELECT 'daily_event_value' AS metric_name, 'event_type' AS entity_type, event_type AS entity_id,
       CAST(day AS VARCHAR) AS moment, value AS x FROM daily_events
UNION ALL
SELECT 'daily_shipment_qty', 'warehouse', warehouse_id, CAST(ship_date AS VARCHAR),
       CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) FROM fact_shipment GROUP BY 3, 4
UNION ALL
SELECT 'daily_return_qty', 'warehouse', warehouse_id, CAST(return_date AS VARCHAR),
       CAST(sum(CAST(qty_returned AS DECIMAL(18,4))) AS DOUBLE) FROM fact_return GROUP BY 3, 4
UNION ALL
SELECT 'inventory_level', 'item:warehouse', item_id || ':' || warehouse_id, CAST(d AS VARCHAR), q FROM stock_daily
UNION ALL
SELECT 'channel_revenue', 'channel', channel_store_id, period,
       CAST(sum(CAST(coalesce(net_revenue_krw, 0) AS DECIMAL(18,4))) AS DOUBLE) FROM mart_pnl_revenue GROUP BY 3, 4

-- name: anomalies
SELECT metric_name, entity_type, entity_id, moment[1:7] AS period, x AS current_value, expected_value, deviation,
       CASE WHEN abs(deviation) >= 3 THEN 'CRITICAL' WHEN abs(deviation) >= 2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (
  SELECT *, (x - expected_value) / std AS deviation
  FROM (
    SELECT *, CAST(s AS DOUBLE) / n AS expected_value,
           sqrt(CAST(CAST(ss AS DECIMAL(35,8)) * n - CAST(s AS DECIMAL(19,4)) * CAST(s AS DECIMAL(19,4)) AS DOUBLE)
                / (CAST(n AS DOUBLE) * (n - 1))) AS std
    FROM (
      SELECT *, CAST(count(*) OVER w AS TINYINT) AS n, sum(CAST(x AS DECIMAL(18,4))) OVER w AS s,
             sum(CAST(x AS DECIMAL(19,4)) * CAST(x AS DECIMAL(19,4))) OVER w AS ss
      FROM series
      WINDOW w AS (PARTITION BY metric_name, entity_id ORDER BY moment ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) a
    WHERE n >= 7) b
  WHERE std > 0) c
WHERE abs(deviation) >= 2

-- name: anomaly_timeseries
SELECT * FROM anomalies WHERE metric_name = 'daily_event_value'

-- name: anomaly_shipments
SELECT * FROM anomalies WHERE metric_name = 'daily_shipment_qty'

-- name: anomaly_returns
SELECT * FROM anomalies WHERE metric_name = 'daily_return_qty'

-- name: anomaly_inventory
SELECT * FROM anomalies WHERE metric_name = 'inventory_level'

-- name: anomaly_revenue
SELECT * FROM anomalies WHERE metric_name = 'channel_revenue'

-- name: mart_anomaly_signals
SELECT *, DATE '2002-01-01' AS detected_at FROM anomalies WHERE metric_name <> 'daily_event_value'
