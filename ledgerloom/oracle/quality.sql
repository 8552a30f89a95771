-- name: dq_required_columns
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, false AS passed, CAST(1 AS BIGINT) AS bad_rows,
       count(*) AS rows
FROM raw_shipments

-- name: dq_null_keys
SELECT 'null_business_key_shipment_id' AS check_name, 'CRITICAL' AS severity, true AS passed, CAST(0 AS BIGINT) AS bad_rows
FROM raw_shipments HAVING count(*) > 0
UNION ALL
SELECT 'null_business_key_item_id', 'CRITICAL', true, CAST(0 AS BIGINT) FROM raw_shipments HAVING count(*) > 0
UNION ALL
SELECT 'null_business_key_lot_id', 'CRITICAL', count(*) FILTER (WHERE lot_id IS NULL) = 0, count(*) FILTER (WHERE lot_id IS NULL)
FROM raw_shipments

-- name: dq_duplicate_keys
SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, sum(n) = 0 AS passed, CAST(sum(n) AS BIGINT) AS bad_rows
FROM (SELECT count(*) - 1 AS n FROM upload_shipment GROUP BY shipment_id, item_id, lot_id) t

-- name: dq_type_coercion
SELECT 'type_coercion_' || c AS check_name, 'HIGH' AS severity, bad = 0 AS passed, bad AS bad_rows
FROM (SELECT count(*) FILTER (WHERE qty_shipped = 'n/a') AS n FROM raw_shipments) t,
     LATERAL (SELECT unnest(['shipment_id', 'ship_date', 'warehouse_id', 'item_id', 'qty_shipped', 'lot_id', 'weight',
                             'channel_order_id']) AS c) u,
     LATERAL (SELECT CASE WHEN c = 'qty_shipped' THEN n ELSE 0 END AS bad) v

-- name: raw_charges
SELECT * REPLACE (CASE WHEN period[6:7] = '07' AND invoice_line_no = 5 THEN 'MYSTERY_FEE' ELSE charge_type END AS charge_type)
FROM fact_charge_actual

-- name: dq_charge_types
SELECT 'charge_type_validation' AS check_name, 'HIGH' AS severity, count(*) = 0 AS passed, count(*) AS bad_rows
FROM (SELECT DISTINCT charge_type FROM raw_charges WHERE charge_type = 'MYSTERY_FEE') t

-- name: upload_inventory_snapshot
SELECT warehouse_id || '.csv' AS source_file_name,
       ((CAST(item_id AS BIGINT) * 3 + CAST(lot_id[2:2] AS INTEGER)) * 60 + (snapshot_date - DATE '1998-01-01')) * 2 + c AS source_row_no,
       snapshot_date, warehouse_id, item_id, CASE WHEN k <> 3 THEN lot_id END AS lot_id,
       CASE WHEN k = 5 THEN -onhand_qty ELSE onhand_qty END AS onhand_qty, onhand_qty + k - 8 AS sellable_qty,
       CASE WHEN k = 1 THEN onhand_qty + 1 ELSE 1.0 END AS blocked_qty, CASE WHEN k <> 2 THEN 2.0::DOUBLE END AS reserved_qty
FROM (SELECT *, CAST(item_id AS INTEGER) % 10 AS k FROM fact_inventory_snapshot) s, range(2) r(c)
WHERE c = 0 OR k = 7

-- name: dq_quantity_range
SELECT 'quantity_range_onhand_qty' AS check_name, 'HIGH' AS severity, count(*) = 0 AS passed, count(*) AS bad_rows,
       (SELECT string_agg(x, ', ' ORDER BY x) FROM (
          SELECT source_file_name || ':' || source_row_no AS x FROM upload_inventory_snapshot WHERE onhand_qty < 0
          ORDER BY source_file_name, source_row_no LIMIT 5) f) AS sample
FROM upload_inventory_snapshot WHERE onhand_qty < 0

-- name: dq_amount_outlier
SELECT 'amount_outlier_net_payout' AS check_name, 'MEDIUM' AS severity,
       count(*) FILTER (WHERE abs(net_revenue_krw) > 100000000) = 0 AS passed,
       count(*) FILTER (WHERE abs(net_revenue_krw) > 100000000) AS bad_rows
FROM mart_pnl_revenue
UNION ALL
SELECT 'amount_outlier_gross_sales', 'MEDIUM', count(*) FILTER (WHERE abs(gross_sales_krw) > 100000000) = 0,
       count(*) FILTER (WHERE abs(gross_sales_krw) > 100000000)
FROM mart_pnl_revenue

-- name: dq_date_range
SELECT 'date_range_future_ship_date' AS check_name, 'MEDIUM' AS severity, n = 0 AS passed, n AS bad_rows
FROM (SELECT count(*) FILTER (WHERE ship_date > DATE '2002-01-01' + 60) AS n FROM cast_columns) a
UNION ALL
SELECT 'date_range_past_ship_date', 'MEDIUM', n = 0, n
FROM (SELECT count(*) FILTER (WHERE ship_date < DATE '2002-01-01' - 3650) AS n FROM cast_columns) b

-- name: dq_period_continuity
SELECT 'period_continuity' AS check_name, 'MEDIUM' AS severity, count(*) = 0 AS passed, count(*) AS bad_rows
FROM (SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m') AS period
      FROM (SELECT CAST(min(period) || '-01' AS TIMESTAMP) AS lo, CAST(max(period) || '-01' AS TIMESTAMP) AS hi
            FROM fact_exchange_rate WHERE currency = 'EUR') s) m
WHERE period NOT IN (SELECT period FROM fact_exchange_rate WHERE currency = 'EUR')

-- name: dq_cross_ship_vs_inventory
SELECT 'cross_shipment_vs_inventory' AS check_name, 'MEDIUM' AS severity, NOT over_it AS passed,
       CAST(over_it AS BIGINT) AS bad_rows
FROM (SELECT (SELECT sum(qty_shipped) FROM fact_shipment) > (SELECT sum(onhand_qty) FROM fact_inventory_snapshot) AS over_it) t

-- name: dq_cross_return_vs_ship
SELECT 'cross_return_vs_shipment' AS check_name, 'MEDIUM' AS severity, NOT over_it AS passed,
       CAST(over_it AS BIGINT) AS bad_rows
FROM (SELECT (SELECT sum(qty_returned) FROM fact_return) > (SELECT sum(qty_shipped) FROM fact_shipment) AS over_it) t

-- name: file_orders
SELECT * REPLACE (CASE WHEN md5(CAST(channel_order_id AS VARCHAR))[1] = '0' THEN -qty_ordered ELSE qty_ordered END AS qty_ordered)
FROM fact_order

-- name: report_orders
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'null_business_key_channel_order_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE channel_order_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'null_business_key_line_no' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE line_no IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_channel_order_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_line_no' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE line_no IS NOT NULL AND TRY_CAST(line_no AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_order_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_channel_store_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_qty_ordered' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE qty_ordered IS NOT NULL AND TRY_CAST(qty_ordered AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'type_coercion_ship_from_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'quantity_range_qty_ordered' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(qty_ordered AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT CAST(regexp_replace(channel_order_id, '[^0-9]', '', 'g') AS BIGINT) * 10 + line_no AS r FROM file_orders WHERE TRY_CAST(qty_ordered AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM file_orders
UNION ALL SELECT 'date_range_future_order_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(order_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'date_range_past_order_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(order_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (channel_order_id, line_no)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_orders

-- name: report_shipments
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(1) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'null_business_key_shipment_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE shipment_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'null_business_key_lot_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE lot_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_shipment_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_ship_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_qty_shipped' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE qty_shipped IS NOT NULL AND TRY_CAST(qty_shipped AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_lot_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_weight' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE weight IS NOT NULL AND TRY_CAST(weight AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'type_coercion_channel_order_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'quantity_range_qty_shipped' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(qty_shipped AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT CAST(regexp_replace(shipment_id, '[^0-9]', '', 'g') AS BIGINT) AS r FROM raw_shipments WHERE TRY_CAST(qty_shipped AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM raw_shipments
UNION ALL SELECT 'date_range_future_ship_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(ship_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'date_range_past_ship_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(ship_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (shipment_id, item_id, lot_id)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_shipments
UNION ALL SELECT 'cross_shipment_vs_inventory', 'MEDIUM', CAST((SELECT sum(qty_shipped) FROM cast_columns) > (SELECT sum(onhand_qty) FROM fact_inventory_snapshot) AS BIGINT), NULL

-- name: file_returns
SELECT * REPLACE (CASE WHEN md5(CAST(return_id AS VARCHAR))[1] = '0' THEN -qty_returned ELSE qty_returned END AS qty_returned)
FROM fact_return

-- name: report_returns
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'null_business_key_return_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE return_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'null_business_key_lot_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE lot_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_return_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_return_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_qty_returned' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE qty_returned IS NOT NULL AND TRY_CAST(qty_returned AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_lot_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_channel_order_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_reason' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'type_coercion_disposition' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'quantity_range_qty_returned' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(qty_returned AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT CAST(regexp_replace(return_id, '[^0-9]', '', 'g') AS BIGINT) AS r FROM file_returns WHERE TRY_CAST(qty_returned AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM file_returns
UNION ALL SELECT 'date_range_future_return_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(return_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'date_range_past_return_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(return_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (return_id, item_id, lot_id)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_returns
UNION ALL SELECT 'cross_return_vs_shipment', 'MEDIUM', CAST((SELECT sum(qty_returned) FROM file_returns) > (SELECT sum(qty_shipped) FROM fact_shipment) AS BIGINT), NULL

-- name: file_inventory
SELECT * REPLACE (CASE WHEN md5(CAST(snapshot_date AS VARCHAR))[1] = '0' THEN -onhand_qty ELSE onhand_qty END AS onhand_qty)
FROM fact_inventory_snapshot

-- name: report_inventory
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'null_business_key_snapshot_date' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE snapshot_date IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'null_business_key_warehouse_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE warehouse_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'null_business_key_lot_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE lot_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_snapshot_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_lot_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_onhand_qty' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE onhand_qty IS NOT NULL AND TRY_CAST(onhand_qty AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_expiry_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_qc_status' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'type_coercion_hold_flag' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'quantity_range_onhand_qty' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(onhand_qty AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT ((CAST(regexp_replace(item_id, '[^0-9]', '', 'g') AS BIGINT) * 3 + CAST(regexp_replace(lot_id, '[^0-9]', '', 'g') AS BIGINT)) * 60 + (snapshot_date - DATE '1998-01-01')) * 5 + CAST(regexp_replace(warehouse_id, '[^0-9]', '', 'g') AS BIGINT) AS r FROM file_inventory WHERE TRY_CAST(onhand_qty AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM file_inventory
UNION ALL SELECT 'date_range_future_snapshot_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(snapshot_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'date_range_past_snapshot_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(snapshot_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'date_range_future_expiry_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(expiry_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'date_range_past_expiry_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(expiry_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (snapshot_date, warehouse_id, item_id, lot_id)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_inventory

-- name: file_purchases
SELECT * REPLACE (CASE WHEN md5(CAST(po_id AS VARCHAR))[1] = '0' THEN -qty_ordered ELSE qty_ordered END AS qty_ordered)
FROM fact_po

-- name: report_purchases
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'null_business_key_po_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE po_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_po_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_po_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_supplier_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_qty_ordered' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE qty_ordered IS NOT NULL AND TRY_CAST(qty_ordered AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_eta_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_currency' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'type_coercion_unit_price' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE unit_price IS NOT NULL AND TRY_CAST(unit_price AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'quantity_range_qty_ordered' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(qty_ordered AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT CAST(regexp_replace(po_id, '[^0-9]', '', 'g') AS BIGINT) AS r FROM file_purchases WHERE TRY_CAST(qty_ordered AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM file_purchases
UNION ALL SELECT 'amount_outlier_unit_price' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE abs(TRY_CAST(unit_price AS DOUBLE)) > 100000000) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'date_range_future_po_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(po_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'date_range_past_po_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(po_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'date_range_future_eta_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(eta_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'date_range_past_eta_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(eta_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (po_id, item_id)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_purchases

-- name: file_receipts
SELECT * REPLACE (CASE WHEN md5(CAST(receipt_id AS VARCHAR))[1] = '0' THEN -qty_received ELSE qty_received END AS qty_received)
FROM fact_receipt

-- name: report_receipts
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'null_business_key_receipt_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE receipt_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_receipt_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_receipt_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_qty_received' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE qty_received IS NOT NULL AND TRY_CAST(qty_received AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_po_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_lot_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'type_coercion_mfg_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'quantity_range_qty_received' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(qty_received AS DOUBLE) < 0) AS BIGINT) AS bad_rows, (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT CAST(regexp_replace(receipt_id, '[^0-9]', '', 'g') AS BIGINT) * 2 + CASE source_system WHEN 'ERP' THEN 1 ELSE 0 END AS r FROM file_receipts WHERE TRY_CAST(qty_received AS DOUBLE) < 0 ORDER BY r LIMIT 5) s) AS sample FROM file_receipts
UNION ALL SELECT 'date_range_future_receipt_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(receipt_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'date_range_past_receipt_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(receipt_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'date_range_future_mfg_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(mfg_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'date_range_past_mfg_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(mfg_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (receipt_id, item_id)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM file_receipts

-- name: report_settlements
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'null_business_key_settlement_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE settlement_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'null_business_key_line_no' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE line_no IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_settlement_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_line_no' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE line_no IS NOT NULL AND TRY_CAST(line_no AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_period' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_channel_store_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_currency' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_gross_sales' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE gross_sales IS NOT NULL AND TRY_CAST(gross_sales AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_discounts' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE discounts IS NOT NULL AND TRY_CAST(discounts AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_fees' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE fees IS NOT NULL AND TRY_CAST(fees AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_refunds' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE refunds IS NOT NULL AND TRY_CAST(refunds AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'type_coercion_net_payout' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE net_payout IS NOT NULL AND TRY_CAST(net_payout AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'amount_outlier_net_payout' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE abs(TRY_CAST(net_payout AS DOUBLE)) > 100000000) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'amount_outlier_gross_sales' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE abs(TRY_CAST(gross_sales AS DOUBLE)) > 100000000) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (settlement_id, line_no)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement
UNION ALL SELECT 'period_continuity' AS check_name, 'MEDIUM' AS severity, CAST(max((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) - min((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) + 1 - count(DISTINCT period) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_settlement

-- name: report_charges
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'null_business_key_invoice_no' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE invoice_no IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'null_business_key_invoice_line_no' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE invoice_line_no IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'null_business_key_charge_type' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE charge_type IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_source_system' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_invoice_no' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_invoice_line_no' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE invoice_line_no IS NOT NULL AND TRY_CAST(invoice_line_no AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_charge_type' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_amount' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_currency' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_period' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_invoice_date' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_channel_store_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'type_coercion_warehouse_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'amount_outlier_amount' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE abs(TRY_CAST(amount AS DOUBLE)) > 100000000) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'date_range_future_invoice_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(invoice_date AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'date_range_past_invoice_date' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(invoice_date AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (invoice_no, invoice_line_no, charge_type)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'charge_type_validation' AS check_name, 'HIGH' AS severity, CAST(count(DISTINCT charge_type) FILTER (WHERE charge_type = 'MYSTERY_FEE') AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges
UNION ALL SELECT 'period_continuity' AS check_name, 'MEDIUM' AS severity, CAST(max((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) - min((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) + 1 - count(DISTINCT period) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM raw_charges

-- name: report_rates
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'null_business_key_period' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE period IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'null_business_key_currency' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE currency IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'type_coercion_period' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'type_coercion_currency' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'type_coercion_rate_to_krw' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE rate_to_krw IS NOT NULL AND TRY_CAST(rate_to_krw AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (period, currency)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate
UNION ALL SELECT 'period_continuity' AS check_name, 'MEDIUM' AS severity, CAST(max((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) - min((CAST(left(period, 4) AS BIGINT) * 12 + CAST(right(period, 2) AS BIGINT))) + 1 - count(DISTINCT period) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_exchange_rate

-- name: report_costs
SELECT 'required_columns' AS check_name, 'CRITICAL' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'null_business_key_item_id' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE item_id IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'null_business_key_cost_component' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE cost_component IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'null_business_key_effective_from' AS check_name, 'CRITICAL' AS severity, CAST(count(*) FILTER (WHERE effective_from IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'type_coercion_item_id' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'type_coercion_cost_component' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'type_coercion_effective_from' AS check_name, 'HIGH' AS severity, CAST(max(0) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'type_coercion_cost_per_unit_krw' AS check_name, 'HIGH' AS severity, CAST(count(*) FILTER (WHERE cost_per_unit_krw IS NOT NULL AND TRY_CAST(cost_per_unit_krw AS DOUBLE) IS NULL) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'amount_outlier_cost_per_unit_krw' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE abs(TRY_CAST(cost_per_unit_krw AS DOUBLE)) > 100000000) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'date_range_future_effective_from' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(effective_from AS VARCHAR), '/', '-') AS DATE) > DATE '2002-01-01' + 60) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'date_range_past_effective_from' AS check_name, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE TRY_CAST(replace(CAST(effective_from AS VARCHAR), '/', '-') AS DATE) < DATE '2002-01-01' - 3650) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure
UNION ALL SELECT 'duplicate_business_keys' AS check_name, 'HIGH' AS severity, CAST(count(*) - count(DISTINCT (item_id, cost_component, effective_from)) AS BIGINT) AS bad_rows, CAST(NULL AS VARCHAR) AS sample FROM fact_cost_structure

-- name: dq_report
SELECT 'orders.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_orders
UNION ALL SELECT 'shipments.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_shipments
UNION ALL SELECT 'returns.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_returns
UNION ALL SELECT 'inventory.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_inventory
UNION ALL SELECT 'purchases.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_purchases
UNION ALL SELECT 'receipts.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_receipts
UNION ALL SELECT 'settlements.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_settlements
UNION ALL SELECT 'charges.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_charges
UNION ALL SELECT 'rates.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_rates
UNION ALL SELECT 'costs.csv' AS file_name, check_name, severity, bad_rows = 0 AS passed, bad_rows, sample FROM report_costs

-- name: dq_gate
SELECT file_name, count(*) FILTER (WHERE NOT passed AND severity IN ('CRITICAL', 'HIGH')) AS failures,
       count(*) FILTER (WHERE NOT passed AND severity IN ('MEDIUM', 'LOW')) AS warnings,
       bool_or(NOT passed AND severity IN ('CRITICAL', 'HIGH')) AS rejected
FROM dq_report GROUP BY 1

-- name: file_and_dq_logs
SELECT r.*, CASE WHEN rejected THEN 'dq_failed' ELSE 'success' END AS file_status, 42 AS batch_id
FROM dq_report r JOIN dq_gate g ON r.file_name = g.file_name

-- name: policy_validate
SELECT invoice_no, invoice_line_no, charge_type, 'unknown charge type' AS problem
FROM raw_charges WHERE charge_type = 'MYSTERY_FEE'

-- name: dq_upload_keys
SELECT source_file_name, source_row_no, 'duplicate business key' AS problem
FROM (SELECT *, row_number() OVER (PARTITION BY source_file_name, snapshot_date, warehouse_id, item_id,
               coalesce(lot_id, '__NONE__') ORDER BY source_row_no) AS rn
      FROM upload_inventory_snapshot) t
WHERE rn > 1

-- name: dq_upload_nonneg
SELECT source_file_name, source_row_no, 'onhand_qty is negative' AS problem FROM upload_inventory_snapshot WHERE onhand_qty < 0
UNION ALL SELECT source_file_name, source_row_no, 'sellable_qty is negative' FROM upload_inventory_snapshot WHERE sellable_qty < 0
UNION ALL SELECT source_file_name, source_row_no, 'blocked_qty is negative' FROM upload_inventory_snapshot WHERE blocked_qty < 0
UNION ALL SELECT source_file_name, source_row_no, 'reserved_qty is negative' FROM upload_inventory_snapshot WHERE reserved_qty < 0

-- name: dq_upload_inventory
SELECT source_file_name, source_row_no, 'sellable_qty exceeds onhand_qty' AS problem
FROM upload_inventory_snapshot WHERE sellable_qty > onhand_qty
UNION ALL SELECT source_file_name, source_row_no, 'blocked_qty exceeds onhand_qty'
FROM upload_inventory_snapshot WHERE blocked_qty > onhand_qty
UNION ALL SELECT source_file_name, source_row_no, 'sellable + blocked + reserved exceeds onhand_qty'
FROM upload_inventory_snapshot WHERE sellable_qty + blocked_qty + reserved_qty > onhand_qty

-- name: dq_upload_dates
SELECT supplier_id || '.csv' AS source_file_name, po_id AS row_key, 'eta_date before po_date' AS problem
FROM fact_po
WHERE CASE WHEN CAST(item_id AS INTEGER) % 10 = 0 THEN po_date - 1 ELSE eta_date END < po_date
UNION ALL
SELECT warehouse_id || '.csv', receipt_id, 'mfg_date after receipt_date' FROM fact_receipt WHERE CAST(item_id AS INTEGER) % 10 = 0
UNION ALL
SELECT warehouse_id || '.csv', receipt_id, 'expiry_date before mfg_date' FROM fact_receipt WHERE CAST(item_id AS INTEGER) % 10 = 1
UNION ALL
SELECT source_file_name, CAST(raw_id AS VARCHAR), 'ship_date before promised_ship_date'
FROM upload_shipment WHERE ship_date < promised_ship_date
UNION ALL
SELECT source_file_name, CAST(raw_id AS VARCHAR), 'delivered_at before ship_date'
FROM upload_shipment WHERE delivered_at < ship_date

-- name: dq_upload_periods
SELECT settlement_id || '.csv' AS source_file_name, line_no, 'order_date outside period' AS problem
FROM fact_settlement WHERE line_no % 10 = 0
UNION ALL SELECT settlement_id || '.csv', line_no, 'ship_date outside period' FROM fact_settlement WHERE line_no % 10 = 1
UNION ALL SELECT invoice_no || '.csv', invoice_line_no, 'invoice_date outside period' FROM fact_charge_actual WHERE invoice_line_no = 2
UNION ALL SELECT invoice_no || '.csv', invoice_line_no, 'reference_period after period' FROM fact_charge_actual WHERE invoice_line_no = 3

-- name: dq_upload_error_report
SELECT source_file_name, line_no, problem FROM dq_upload_periods
