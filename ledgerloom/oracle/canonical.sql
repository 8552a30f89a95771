-- name: li
SELECT * EXCLUDE (rn, l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate
FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice,
             l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem) t
WHERE rn = 1

-- name: dim_item
SELECT CAST(p_partkey AS VARCHAR) AS item_id,
       CASE p_partkey % 4 WHEN 0 THEN 'RM' WHEN 1 THEN 'PM' WHEN 2 THEN 'WIP' ELSE 'FG' END AS item_type,
       CASE WHEN p_partkey % 5 = 0 THEN 45 END AS min_sellable_days,
       p_partkey % 19 = 0 AS qc_required_flag,
       365 AS shelf_life_days
FROM part

-- name: fact_order
SELECT CAST(o_orderkey AS VARCHAR) AS channel_order_id,
       CAST(coalesce(l_linenumber, 1) AS BIGINT) AS line_no,
       CAST(o_orderdate AS DATE) AS order_date,
       'S' || (o_orderkey % 10) AS channel_store_id,
       CAST(coalesce(l_partkey, o_orderkey % 100) AS VARCHAR) AS item_id,
       coalesce(l_quantity, 10.0) AS qty_ordered,
       'W' || (coalesce(l_suppkey, o_orderkey) % 5) AS ship_from_warehouse_id
FROM orders LEFT JOIN li ON o_orderkey = l_orderkey

-- name: fact_shipment
SELECT 'WMS' AS source_system,
       l_orderkey || '-' || l_linenumber AS shipment_id,
       l_shipdate AS ship_date,
       'W' || (l_suppkey % 5) AS warehouse_id,
       CAST(l_partkey AS VARCHAR) AS item_id,
       'L' || (l_partkey % 3) AS lot_id,
       l_quantity AS qty_shipped,
       CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 0.5::DOUBLE END AS weight,
       l_quantity * 0.01::DOUBLE AS volume_cbm,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS VARCHAR) END AS channel_order_id,
       'S' || (l_orderkey % 10) AS channel_store_id
FROM li WHERE l_linestatus = 'F'

-- name: fact_return
SELECT 'WMS' AS source_system,
       'R' || l_orderkey || '-' || l_linenumber AS return_id,
       l_shipdate + CAST(5 + l_linenumber AS INTEGER) AS return_date,
       'W' || (l_suppkey % 5) AS warehouse_id,
       CAST(l_partkey AS VARCHAR) AS item_id,
       'L' || (l_partkey % 3) AS lot_id,
       CAST(ceil(l_quantity / 5) AS DOUBLE) AS qty_returned,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS VARCHAR) END AS channel_order_id,
       CASE l_partkey % 4 WHEN 0 THEN 'DAMAGED' WHEN 1 THEN 'WRONG_ITEM' WHEN 2 THEN 'CHANGE_OF_MIND' END AS reason,
       CASE l_suppkey % 3 WHEN 0 THEN 'RESTOCK' WHEN 1 THEN 'SCRAP' ELSE 'REFURBISH' END AS disposition
FROM li WHERE l_linestatus = 'F' AND l_returnflag = 'R'

-- name: fact_po
SELECT 'PO' || l_orderkey || '-' || l_linenumber AS po_id,
       l_shipdate - 20 AS po_date,
       CAST(l_suppkey AS VARCHAR) AS supplier_id,
       CAST(l_partkey AS VARCHAR) AS item_id,
       l_quantity AS qty_ordered,
       CASE WHEN l_partkey % 9 <> 0 THEN l_shipdate END AS eta_date,
       'USD' AS currency,
       l_extendedprice / l_quantity AS unit_price
FROM li WHERE l_linestatus = 'O'

-- name: fact_receipt
SELECT src AS source_system,
       src[1] || 'R' || l_orderkey || '-' || l_linenumber AS receipt_id,
       l_shipdate + CAST(l_partkey % 15 - 4 AS INTEGER) AS receipt_date,
       'W' || (l_suppkey % 5) AS warehouse_id,
       CAST(l_partkey AS VARCHAR) AS item_id,
       CASE WHEN src = 'WMS' THEN CAST(floor(l_quantity * 0.9::DOUBLE) AS DOUBLE) ELSE l_quantity END AS qty_received,
       'PO' || l_orderkey || '-' || l_linenumber AS po_id,
       'L' || (l_partkey % 3) AS lot_id,
       CASE WHEN l_partkey % 8 = 0 THEN l_shipdate + CAST(l_partkey % 15 - 34 AS INTEGER) END AS mfg_date
FROM li, (VALUES ('WMS', 5), ('ERP', 4)) AS s(src, last_line)
WHERE l_linestatus = 'O' AND l_linenumber <= last_line

-- name: fact_inventory_snapshot
SELECT DATE '1998-01-01' + CAST(d AS INTEGER) AS snapshot_date,
       'W' || wh AS warehouse_id,
       CAST(p_partkey AS VARCHAR) AS item_id,
       'L' || lot AS lot_id,
       CAST(40 + (p_partkey * 7 + wh * 5 + lot * 11 + d * 3) % 60 AS DOUBLE) AS onhand_qty,
       CASE WHEN p_partkey % 4 <> 0
            THEN DATE '1998-01-10' + CAST((p_partkey * 13 + lot * 37) % 500 AS INTEGER) END AS expiry_date,
       CASE WHEN lot = 0 THEN 'Released' ELSE 'PENDING' END AS qc_status,
       p_partkey % 17 = 0 AS hold_flag
FROM part, range(5) w(wh), range(3) l(lot), range(20) dd(d)

-- name: fact_settlement
SELECT *, gross_sales - discounts - fees - refunds AS net_payout, 'STL-' || period AS settlement_id
FROM (
  SELECT strftime(l_shipdate, '%Y-%m') AS period,
         l_orderkey * 10 + l_linenumber AS line_no,
         'S' || (l_orderkey % 10) AS channel_store_id,
         CAST(l_partkey AS VARCHAR) AS item_id,
         CASE l_orderkey % 3 WHEN 0 THEN 'KRW' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
         l_extendedprice AS gross_sales,
         l_extendedprice * l_discount AS discounts,
         l_extendedprice * 0.03::DOUBLE AS fees,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.1::DOUBLE ELSE 0.0::DOUBLE END AS refunds
  FROM li WHERE l_linestatus = 'F' AND l_partkey % 23 <> 0) s

-- name: fact_exchange_rate
SELECT period, currency, rate_to_krw
FROM (SELECT DISTINCT strftime(ship_date, '%Y-%m') AS period FROM fact_shipment) p,
     (VALUES ('USD', 1300.0::DOUBLE), ('EUR', 1450.0::DOUBLE)) AS r(currency, rate_to_krw)
WHERE currency = 'USD' OR CAST(period[6:7] AS INTEGER) % 2 = 0

-- name: fact_cost_structure
SELECT CAST(p_partkey AS VARCHAR) AS item_id, cost_component, CAST(effective_from AS DATE) AS effective_from,
       p_retailprice * share * uplift AS cost_per_unit_krw
FROM part, (VALUES ('MATERIAL', 0.4::DOUBLE), ('LABOR', 0.1::DOUBLE)) AS c(cost_component, share),
     (VALUES ('1995-01-01', 1.0::DOUBLE), ('1998-01-01', 1.1::DOUBLE)) AS v(effective_from, uplift)
WHERE p_partkey % 13 <> 0

-- name: fact_charge_actual
SELECT 'INV-' || period AS invoice_no, CAST(no AS BIGINT) AS invoice_line_no, charge_type,
       CASE WHEN no = 9 THEN 777777.0 ELSE CAST(100000 + m * 1000 + no * 37 AS DOUBLE) END AS amount,
       'KRW' AS currency, period,
       CASE WHEN no <> 9 THEN 'W' || (m % 5) END AS warehouse_id,
       last_day(CAST(period || '-01' AS DATE)) AS invoice_date
FROM (SELECT DISTINCT strftime(ship_date, '%Y-%m') AS period, month(ship_date) AS m
      FROM fact_shipment) p,
     (VALUES (1, 'LAST_MILE_PARCEL'), (2, 'FREIGHT_INTL_SEA'), (3, '3PL_STORAGE_FEE'), (5, 'DISPOSAL_FEE'),
             (9, 'PLATFORM_FEE')) AS c(no, charge_type)
WHERE no <> 9 OR m = 1

-- name: daily_events
SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value
FROM events GROUP BY 1, 2
