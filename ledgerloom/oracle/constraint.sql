-- name: signal_rows
SELECT 'supply' AS domain, 'late_po_ratio' AS metric_name, round_even(share, 4) AS current_value, 0.2::DOUBLE AS threshold_value,
       CASE WHEN share >= 0.2::DOUBLE * 1.5::DOUBLE THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       'supplier' AS entity_type, supplier_id AS entity_id, period
FROM (SELECT supplier_id, strftime(po_date, '%Y-%m') AS period,
             count(*) FILTER (WHERE eta_date < DATE '2002-01-01' AND r.po_id IS NULL) / count(*) AS share
      FROM fact_po p LEFT JOIN (SELECT DISTINCT po_id FROM fact_receipt) r ON p.po_id = r.po_id
      GROUP BY 1, 2) a
WHERE share >= 0.2
UNION ALL
SELECT 'supply', 'supplier_delay_days', round_even(delay, 1), 7.0, CASE WHEN delay >= 14 THEN 'CRITICAL' ELSE 'HIGH' END,
       'supplier', supplier_id, period
FROM (SELECT supplier_id, strftime(po_date, '%Y-%m') AS period,
             CAST(sum(receipt_date - eta_date) AS DOUBLE) / count(*) AS delay
      FROM fact_po p JOIN fact_receipt r ON p.po_id = r.po_id AND p.item_id = r.item_id
      WHERE eta_date IS NOT NULL GROUP BY 1, 2) b
WHERE delay >= 7
UNION ALL
SELECT 'warehouse_3pl', 'backlog_ship_orders', n, 20.0, CASE WHEN n >= 40 THEN 'CRITICAL' ELSE 'HIGH' END,
       'warehouse', warehouse_id, period
FROM (SELECT coalesce(ship_from_warehouse_id, 'UNKNOWN') AS warehouse_id, strftime(order_date, '%Y-%m') AS period,
             CAST(count(*) AS DOUBLE) AS n
      FROM fact_order o
      WHERE NOT EXISTS (SELECT 1 FROM fact_shipment s
                        WHERE s.channel_order_id = o.channel_order_id AND s.item_id = o.item_id)
      GROUP BY 1, 2) c
WHERE n >= 20
UNION ALL
SELECT 'logistics_customs', 'dwell_time_days', round_even(dwell, 1), 5.0, 'HIGH', 'warehouse', warehouse_id, period
FROM (SELECT warehouse_id, strftime(receipt_date, '%Y-%m') AS period,
             CAST(sum(receipt_date - eta_date) AS DOUBLE) / count(*) AS dwell
      FROM fact_receipt r JOIN fact_po p ON p.po_id = r.po_id AND p.item_id = r.item_id
      WHERE eta_date IS NOT NULL GROUP BY 1, 2) d
WHERE dwell >= 5
UNION ALL
SELECT 'demand_channel', 'return_rate_spike', round_even(rate, 4), 0.002, 'HIGH', 'channel', channel, period
FROM (SELECT channel, r.period, r.v / coalesce(s.v, 1.0) AS rate
      FROM (SELECT coalesce(channel_order_id, 'UNKNOWN') AS channel, strftime(return_date, '%Y-%m') AS period,
                   CAST(sum(CAST(qty_returned AS DECIMAL(18,4))) AS DOUBLE) AS v FROM fact_return GROUP BY 1, 2) r
      LEFT JOIN (SELECT strftime(ship_date, '%Y-%m') AS period, CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS v
                 FROM fact_shipment GROUP BY 1) s ON r.period = s.period) e
WHERE rate >= 0.002
UNION ALL
SELECT 'finance', 'expired_value_at_risk', CAST(sum(CAST(expired_qty AS DECIMAL(18,4))) AS DOUBLE), 0.0, 'CRITICAL', 'item',
       item_id || '|' || warehouse_id, CAST(snapshot_date AS VARCHAR)
FROM lots WHERE expired_qty > 0 GROUP BY item_id, warehouse_id, snapshot_date

-- name: signals
SELECT 'SIG-' || upper(sha256(metric_name || '|' || entity_id || '|' || period)[1:16]) AS signal_id, *
FROM signal_rows

-- name: signal_late_po
SELECT * FROM signals WHERE metric_name = 'late_po_ratio'

-- name: signal_supplier_delay
SELECT * FROM signals WHERE metric_name = 'supplier_delay_days'

-- name: signal_backlog
SELECT * FROM signals WHERE metric_name = 'backlog_ship_orders'

-- name: signal_dwell
SELECT * FROM signals WHERE metric_name = 'dwell_time_days'

-- name: signal_return_spike
SELECT * FROM signals WHERE metric_name = 'return_rate_spike'

-- name: signal_expired_value
SELECT * FROM signals WHERE metric_name = 'expired_value_at_risk'

-- name: mart_constraint_signals
SELECT *, DATE '2002-01-01' AS detected_at FROM signals

-- name: constraint_issues
SELECT signal_id AS issue_id, 'CONSTRAINT_' || metric_name AS issue_type, severity, domain, entity_type, entity_id,
       period, metric_name || ' exceeds threshold' AS detail
FROM signals WHERE severity = 'CRITICAL'

-- name: mart_constraint_root_cause
SELECT signal_id,
       CASE metric_name WHEN 'late_po_ratio' THEN 'Supplier delivery performance below target'
         WHEN 'supplier_delay_days' THEN 'Supplier production delays'
         WHEN 'backlog_ship_orders' THEN 'Warehouse processing capacity exceeded'
         WHEN 'dwell_time_days' THEN 'Port/customs clearance delays'
         WHEN 'return_rate_spike' THEN 'Product quality or fulfillment errors'
         ELSE 'Inventory aging beyond shelf life' END AS root_cause,
       CASE metric_name WHEN 'late_po_ratio' THEN 'Late shipments, capacity constraints'
         WHEN 'supplier_delay_days' THEN 'Lead time variability, raw material shortage'
         WHEN 'backlog_ship_orders' THEN 'Staffing shortage, space constraints'
         WHEN 'dwell_time_days' THEN 'Documentation issues, inspection holds'
         WHEN 'return_rate_spike' THEN 'Damaged goods, wrong items shipped'
         ELSE 'Over-ordering, demand forecast error' END AS contributing_factors,
       domain, period
FROM signals WHERE severity IN ('CRITICAL', 'HIGH')

-- name: mart_constraint_action_plan
SELECT signal_id,
       CASE metric_name WHEN 'late_po_ratio' THEN 'Escalate to procurement; evaluate alternate suppliers'
         WHEN 'supplier_delay_days' THEN 'Negotiate expedited shipping; increase safety stock'
         WHEN 'backlog_ship_orders' THEN 'Add temporary labor; prioritize by SLA'
         WHEN 'dwell_time_days' THEN 'Pre-clear documentation; engage customs broker'
         WHEN 'return_rate_spike' THEN 'Root cause analysis on returns; quality audit'
         ELSE 'Markdown/donation plan; adjust reorder parameters' END AS action,
       CASE WHEN metric_name IN ('backlog_ship_orders', 'expired_value_at_risk') THEN 'CRITICAL'
            WHEN metric_name = 'dwell_time_days' THEN 'MEDIUM' ELSE 'HIGH' END AS priority,
       CASE metric_name WHEN 'late_po_ratio' THEN 'Procurement' WHEN 'supplier_delay_days' THEN 'Supply Chain'
         WHEN 'backlog_ship_orders' THEN 'Warehouse Ops' WHEN 'dwell_time_days' THEN 'Logistics'
         WHEN 'return_rate_spike' THEN 'Quality/CS' ELSE 'Planning' END AS responsible,
       domain, period
FROM signals

-- name: mart_constraint_effectiveness
SELECT signal_id, metric_name, current_value AS before_value, 0.0::DOUBLE AS after_value, -current_value AS delta,
       true AS resolved, period
FROM signals WHERE severity = 'CRITICAL' AND CAST(period[6:7] AS INTEGER) % 2 = 0
