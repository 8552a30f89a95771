-- name: read_csv_strings
SELECT shipment_id, CAST(ship_date AS VARCHAR) AS ship_date, warehouse_id, CAST(qty_shipped AS VARCHAR) AS qty_shipped,
       CAST(weight AS VARCHAR) AS weight
FROM fact_shipment

-- name: inbox_files
SELECT '출고번호,출고일,창고,SKU,lot_id,출고수량,중량,order_id,memo' AS header, 'fact_shipment' AS table_name,
       5 / 6 AS score, 6 / 7 AS upload_score, 'ok' AS verdict, (SELECT count(*) FROM fact_shipment) AS rows
UNION ALL
SELECT 'system,주문번호,라인,주문일,스토어ID,상품코드,주문수량', 'fact_order', 1.0, 1.0, 'ok', (SELECT count(*) FROM fact_order)
UNION ALL
SELECT 'source_system,po_id,po_date,supplier_id,item_id,qty_ordered,eta_date,currency,unit_price', 'fact_po', 1.0, 1.0, 'ok',
       (SELECT count(*) FROM fact_po)
UNION ALL
SELECT 'day,event_type,value', NULL, 0.0, 0.0, 'no match', (SELECT count(*) FROM daily_events)

-- name: inbox_scan
SELECT header, rows FROM inbox_files

-- name: file_dedup
SELECT header, rows FROM inbox_files WHERE table_name IS DISTINCT FROM 'fact_order'

-- name: inbox_stream
SELECT 'OMS' AS source_system, channel_order_id, line_no, order_date, channel_store_id, item_id, qty_ordered, CAST(1 AS BIGINT) AS load_batch_id
FROM fact_order

-- name: detect_table
SELECT header, table_name, CAST(score AS DOUBLE) AS score, verdict, rows FROM inbox_files

-- name: detect_table_upload
SELECT header, table_name, CAST(upload_score AS DOUBLE) AS score, verdict, rows FROM inbox_files

-- name: raw_shipments
SELECT shipment_id,
       CASE WHEN k % 41 = 0 THEN 'soon' WHEN k % 61 = 0 THEN '2010-01-01' WHEN k % 67 = 0 THEN '1985-05-05'
            WHEN k % 3 = 0 THEN strftime(ship_date, '%Y/%m/%d') ELSE CAST(ship_date AS VARCHAR) END AS ship_date,
       warehouse_id, item_id, CASE WHEN k % 7 <> 0 THEN lot_id END AS lot_id,
       CASE WHEN k % 50 = 0 THEN 'n/a' WHEN k % 53 = 0 THEN '-3' ELSE CAST(qty_shipped AS VARCHAR) END AS qty_shipped,
       CAST(weight AS VARCHAR) AS weight, channel_order_id, 'memo' AS memo
FROM (SELECT *, CAST(item_id AS INTEGER) AS k FROM fact_shipment) t

-- name: apply_aliases
SELECT * FROM raw_shipments

-- name: filter_columns
SELECT * EXCLUDE (memo) FROM raw_shipments

-- name: cast_columns
SELECT shipment_id, try_cast(replace(ship_date, '/', '-') AS DATE) AS ship_date, warehouse_id, item_id, lot_id,
       try_cast(qty_shipped AS DOUBLE) AS qty_shipped, try_cast(weight AS DOUBLE) AS weight, channel_order_id
FROM raw_shipments

-- name: add_system_columns
SELECT * REPLACE (coalesce(lot_id, '__NONE__') AS lot_id), 'unknown' AS source_system, CAST(NULL AS VARCHAR) AS source_pk,
       CAST(42 AS BIGINT) AS load_batch_id, sha256('inbox.csv') AS source_file_hash, DATE '2002-01-01' AS loaded_at
FROM cast_columns

-- name: parse_upload_values
SELECT settlement_id, CAST(line_no AS DOUBLE) AS line_no, period,
       CASE WHEN k <> 2 THEN channel_store_id END AS channel_store_id, CASE WHEN k <> 3 THEN currency END AS currency,
       CASE WHEN k <> 4 THEN CAST(1000 + line_no % 1000 AS DOUBLE) END AS gross_sales,
       CASE WHEN k <> 7 THEN k <> 6 END AS accrual_flag
FROM (SELECT *, line_no % 10 AS k FROM fact_settlement) t

-- name: reject_missing_required
SELECT line_no AS source_row_no, CASE WHEN line_no % 10 = 2 THEN 'channel_store_id' ELSE 'currency' END AS missing
FROM fact_settlement WHERE line_no % 10 IN (2, 3)

-- name: upload_shipment
SELECT l_suppkey AS batch_id,
       (l_partkey * 100 + CAST(l_quantity AS BIGINT)) * 10000 + (CAST(l_shipdate AS DATE) - DATE '1990-01-01') AS raw_id,
       'ship_' || l_suppkey || '.csv' AS source_file_name, 'SH' || l_orderkey AS shipment_id,
       CAST(l_partkey % 5 AS VARCHAR) AS item_id,
       CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'L' || (l_partkey % 3) END AS lot_id,
       CAST(l_shipdate AS DATE) AS ship_date, 'W' || (l_suppkey % 5) AS warehouse_id,
       CASE WHEN l_partkey % 97 = 0 THEN -l_quantity ELSE l_quantity END AS qty_shipped,
       l_quantity * 0.5::DOUBLE AS weight, CAST(l_orderkey AS VARCHAR) AS channel_order_id,
       CASE WHEN l_partkey % 2 = 0 THEN 'WMS' END AS source_system,
       CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 13 = 0 THEN 2 ELSE 0 END AS promised_ship_date,
       CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 17 = 0 THEN -1 ELSE 3 END AS delivered_at
FROM lineitem WHERE l_linestatus = 'F'

-- name: upload_content_hash
SELECT 'upload_shipment' AS table_name, source_file_name, count(*) AS row_count, 'success' AS status, CAST(NULL AS BIGINT) AS first_batch, CAST(1 AS BIGINT) AS batch_id
FROM upload_shipment GROUP BY source_file_name
UNION ALL
SELECT t.table_name, 'copy_of_' || source_file_name, count(*), t.status, t.first_batch, t.batch_id
FROM upload_shipment u, (VALUES ('upload_shipment', 'duplicate', 1, 2), ('upload_shipment', 'success', NULL, 3), ('upload_return', 'success', NULL, 4))
  t(table_name, status, first_batch, batch_id)
WHERE u.batch_id % 3 = 0 GROUP BY t.table_name, source_file_name, t.status, t.first_batch, t.batch_id

-- name: promote_latest
SELECT shipment_id, item_id, lot_id, ship_date, warehouse_id, qty_shipped, weight, channel_order_id,
       source_system, batch_id AS load_batch_id, md5(source_file_name) AS source_file_hash, CAST(raw_id AS VARCHAR) AS source_pk
FROM promoted_all WHERE rn = 1

-- name: promote_datasets
SELECT 'inventory_snapshot' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(snapshot_date AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(snapshot_date AS VARCHAR))[1] < '5' THEN onhand_qty + 1000 ELSE onhand_qty END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(snapshot_date AS VARCHAR))[1] < '5') AS corrected FROM fact_inventory_snapshot
UNION ALL SELECT 'purchase_order' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(po_id AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(po_id AS VARCHAR))[1] < '5' THEN qty_ordered + 1000 ELSE qty_ordered END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(po_id AS VARCHAR))[1] < '5') AS corrected FROM fact_po
UNION ALL SELECT 'receipt' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(receipt_id AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(receipt_id AS VARCHAR))[1] < '5' THEN qty_received + 1000 ELSE qty_received END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(receipt_id AS VARCHAR))[1] < '5') AS corrected FROM fact_receipt
UNION ALL SELECT 'shipment' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(shipment_id AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(shipment_id AS VARCHAR))[1] < '5' THEN qty_shipped + 1000 ELSE qty_shipped END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(shipment_id AS VARCHAR))[1] < '5') AS corrected FROM fact_shipment
UNION ALL SELECT 'return' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(return_id AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(return_id AS VARCHAR))[1] < '5' THEN qty_returned + 1000 ELSE qty_returned END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(return_id AS VARCHAR))[1] < '5') AS corrected FROM fact_return
UNION ALL SELECT 'sales' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(settlement_id AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(settlement_id AS VARCHAR))[1] < '5' THEN net_payout + 1000 ELSE net_payout END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(settlement_id AS VARCHAR))[1] < '5') AS corrected FROM fact_settlement
UNION ALL SELECT 'charge' AS dataset, count(*) AS row_count, CAST(sum(CAST(CASE WHEN md5(CAST(invoice_no AS VARCHAR))[1] = '0' THEN -1.0 WHEN md5(CAST(invoice_no AS VARCHAR))[1] < '5' THEN amount + 1000 ELSE amount END AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (md5(CAST(invoice_no AS VARCHAR))[1] < '5') AS corrected FROM fact_charge_actual

-- name: dq_upload_datasets
SELECT 'inventory_snapshot.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_inventory_snapshot WHERE md5(CAST(snapshot_date AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'inventory_snapshot.csv', 'onhand_qty is negative', count(*) FROM fact_inventory_snapshot WHERE md5(CAST(snapshot_date AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'purchase_order.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_po WHERE md5(CAST(po_id AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'purchase_order.csv', 'qty_ordered is negative', count(*) FROM fact_po WHERE md5(CAST(po_id AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'receipt.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_receipt WHERE md5(CAST(receipt_id AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'receipt.csv', 'qty_received is negative', count(*) FROM fact_receipt WHERE md5(CAST(receipt_id AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'shipment.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_shipment WHERE md5(CAST(shipment_id AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'shipment.csv', 'qty_shipped is negative', count(*) FROM fact_shipment WHERE md5(CAST(shipment_id AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'return.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_return WHERE md5(CAST(return_id AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'return.csv', 'qty_returned is negative', count(*) FROM fact_return WHERE md5(CAST(return_id AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'sales.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_settlement WHERE md5(CAST(settlement_id AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'sales.csv', 'net_payout is negative', count(*) FROM fact_settlement WHERE md5(CAST(settlement_id AS VARCHAR))[1] = '0' HAVING count(*) > 0
UNION ALL SELECT 'charge.csv' AS source_file_name, 'duplicate business key' AS problem, count(*) AS rows FROM fact_charge_actual WHERE md5(CAST(invoice_no AS VARCHAR))[1] < '5' HAVING count(*) > 0
UNION ALL SELECT 'charge.csv', 'amount is negative', count(*) FROM fact_charge_actual WHERE md5(CAST(invoice_no AS VARCHAR))[1] = '0' HAVING count(*) > 0

-- name: upload_clean
SELECT * REPLACE (coalesce(nullif(lot_id, ''), '__NONE__') AS lot_id, coalesce(source_system, 'upload') AS source_system)
FROM upload_shipment

-- name: promoted_all
SELECT *, row_number() OVER (PARTITION BY shipment_id, item_id, lot_id ORDER BY batch_id DESC, raw_id DESC) AS rn,
       row_number() OVER (PARTITION BY shipment_id, item_id, lot_id ORDER BY batch_id % 2 DESC, batch_id DESC, raw_id DESC) AS odd_rn
FROM upload_clean

-- name: upsert_core
SELECT shipment_id, item_id, lot_id, ship_date, warehouse_id, qty_shipped, weight, channel_order_id,
       source_system, batch_id AS load_batch_id, md5(source_file_name) AS source_file_hash, CAST(raw_id AS VARCHAR) AS source_pk
FROM promoted_all WHERE odd_rn = 1

-- name: file_log
SELECT o_custkey % 50 AS batch_id, 'orders_' || o_custkey || '.csv' AS file_name,
       sha256(CAST(o_custkey AS VARCHAR)) AS file_hash, 'fact_order' AS table_name, count(*) AS row_count,
       CASE o_custkey % 7 WHEN 0 THEN 'dq_failed' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'skipped' ELSE 'success' END AS status,
       CAST(max(o_orderdate) AS DATE) AS processed_on
FROM orders GROUP BY o_custkey

-- name: batch_log
SELECT batch_id, min(processed_on) AS started_on, max(processed_on) AS finished_on, count(*) AS file_count,
       CAST(sum(row_count) AS BIGINT) AS rows_ingested,
       CASE WHEN batch_id % 9 = 0 THEN 'failed' ELSE 'success' END AS batch_status
FROM file_log GROUP BY 1

-- name: last_batches
SELECT batch_id FROM batch_log ORDER BY batch_id DESC LIMIT 3

-- name: rollback_batches
SELECT shipment_id, item_id, lot_id, ship_date, warehouse_id, qty_shipped, weight, channel_order_id,
       source_system, batch_id AS load_batch_id, md5(source_file_name) AS source_file_hash, CAST(raw_id AS VARCHAR) AS source_pk
FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id, item_id, lot_id ORDER BY batch_id DESC, raw_id DESC) AS left_rn
      FROM upload_clean WHERE batch_id NOT IN (SELECT batch_id FROM last_batches)) x
WHERE left_rn = 1

-- name: rollback_facts
SELECT 'fact_order' AS table_name, count(*) FILTER (md5(CAST(channel_order_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(qty_ordered AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_order
UNION ALL SELECT 'fact_shipment' AS table_name, count(*) FILTER (md5(CAST(shipment_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_shipment
UNION ALL SELECT 'fact_return' AS table_name, count(*) FILTER (md5(CAST(return_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(qty_returned AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_return
UNION ALL SELECT 'fact_inventory_snapshot' AS table_name, count(*) FILTER (md5(CAST(snapshot_date AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(onhand_qty AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_inventory_snapshot
UNION ALL SELECT 'fact_po' AS table_name, count(*) FILTER (md5(CAST(po_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(qty_ordered AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_po
UNION ALL SELECT 'fact_receipt' AS table_name, count(*) FILTER (md5(CAST(receipt_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(qty_received AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_receipt
UNION ALL SELECT 'fact_settlement' AS table_name, count(*) FILTER (md5(CAST(settlement_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(net_payout AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_settlement
UNION ALL SELECT 'fact_charge_actual' AS table_name, count(*) FILTER (md5(CAST(invoice_no AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_charge_actual
UNION ALL SELECT 'fact_exchange_rate' AS table_name, count(*) FILTER (md5(CAST(period AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(rate_to_krw AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_exchange_rate
UNION ALL SELECT 'fact_cost_structure' AS table_name, count(*) FILTER (md5(CAST(item_id AS VARCHAR))[1] < '5') AS merged_rows, count(*) AS row_count, CAST(sum(CAST(cost_per_unit_krw AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS last_batch FROM fact_cost_structure

-- name: rollback_batch_log
SELECT * REPLACE (CASE WHEN batch_id IN (SELECT batch_id FROM last_batches) THEN 'rolled_back' ELSE batch_status END AS batch_status)
FROM batch_log

-- name: charge_policy_dim
SELECT p.*, (SELECT count(*) FROM fact_charge_actual c WHERE c.charge_type = p.charge_type) AS lines
FROM (VALUES
  ('LAST_MILE_PARCEL', 'logistics_transport', 'outbound', false, 'order_count', 'warn'),
  ('DOMESTIC_TRUCKING', 'logistics_transport', 'outbound', false, 'weight', 'warn'),
  ('FREIGHT_INTL_SEA', 'logistics_transport', 'inbound_landed', true, 'weight', 'warn'),
  ('FREIGHT_INTL_AIR', 'logistics_transport', 'inbound_landed', true, 'weight', 'warn'),
  ('PORT_TERMINAL_FEE', 'logistics_transport', 'inbound_landed', true, 'value', 'warn'),
  ('FORWARDER_FEE', 'logistics_transport', 'inbound_landed', true, 'value', 'warn'),
  ('CUSTOMS_DUTY', 'customs', 'inbound_landed', true, 'value', 'warn'),
  ('CUSTOMS_VAT', 'customs', 'inbound_landed', true, 'value', 'warn'),
  ('BROKER_FEE', 'customs', 'inbound_landed', true, 'value', 'warn'),
  ('CARGO_INSURANCE', 'logistics_transport', 'inbound_landed', true, 'value', 'warn'),
  ('3PL_STORAGE_FEE', '3pl_billing', 'storage', false, 'onhand_cbm_days', 'warn'),
  ('3PL_PICK_PACK_FEE', '3pl_billing', 'outbound', false, 'line_count', 'warn'),
  ('3PL_HANDLING_FEE', '3pl_billing', 'outbound', false, 'line_count', 'warn'),
  ('3PL_RETURN_PROCESSING_FEE', '3pl_billing', 'returns', false, 'line_count', 'warn'),
  ('DISPOSAL_FEE', '3pl_billing', 'returns', false, 'qty', 'warn'),
  ('PLATFORM_FEE', 'platform_fee', 'period', false, 'revenue', 'warn'),
  ('PG_FEE', 'platform_fee', 'period', false, 'revenue', 'warn'),
  ('MARKETING_SPEND', 'marketing', 'period', false, 'revenue', 'warn'))
  AS p(charge_type, charge_domain, cost_stage, capitalizable_flag, default_allocation_basis, severity_if_missing)

-- name: upload_history
SELECT f.*, b.* EXCLUDE (batch_id), count(*) OVER () AS total
FROM file_log f LEFT JOIN batch_log b ON f.batch_id = b.batch_id
WHERE status = 'success' AND table_name = 'fact_order' AND processed_on >= DATE '1995-06-01'
ORDER BY processed_on DESC, file_name LIMIT 50 OFFSET 50

-- name: upload_status_tally
SELECT status, count(*) AS files, CAST(sum(row_count) AS BIGINT) AS rows FROM file_log GROUP BY 1

-- name: table_row_counts
SELECT 'fact_order' AS table_name, count(*) AS row_count FROM fact_order
UNION ALL SELECT 'fact_shipment', count(*) FROM fact_shipment
UNION ALL SELECT 'fact_return', count(*) FROM fact_return
UNION ALL SELECT 'fact_inventory_snapshot', count(*) FROM fact_inventory_snapshot
UNION ALL SELECT 'fact_po', count(*) FROM fact_po
UNION ALL SELECT 'fact_receipt', count(*) FROM fact_receipt
UNION ALL SELECT 'fact_settlement', count(*) FROM fact_settlement
UNION ALL SELECT 'fact_charge_actual', count(*) FROM fact_charge_actual
UNION ALL SELECT 'fact_exchange_rate', count(*) FROM fact_exchange_rate
UNION ALL SELECT 'fact_cost_structure', count(*) FROM fact_cost_structure
UNION ALL SELECT 'dim_item', count(*) FROM dim_item

-- name: status_summary
SELECT 'last_batch' AS section, CAST(batch_id AS VARCHAR) AS label, batch_status AS value
FROM (SELECT * FROM batch_log ORDER BY batch_id DESC LIMIT 1) a
UNION ALL
SELECT 'failed_check', check_name, severity
FROM (SELECT check_name, severity FROM dq_report WHERE NOT passed ORDER BY check_name LIMIT 5) b
UNION ALL
SELECT 'closed_period', period, 'closed' FROM (SELECT period FROM period_state WHERE lock_flag) c
UNION ALL
SELECT 'coverage_gap', domain || '/' || period, severity
FROM (SELECT * FROM mart_coverage_period WHERE severity <> 'OK' ORDER BY severity, domain, period LIMIT 10) d
UNION ALL
SELECT 'issues', severity, CAST(count(*) AS VARCHAR) FROM constraint_issues GROUP BY severity
