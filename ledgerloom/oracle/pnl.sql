-- name: charge_policy
SELECT * FROM (VALUES
  ('LAST_MILE_PARCEL', 'logistics_transport', 'outbound', false),
  ('DOMESTIC_TRUCKING', 'logistics_transport', 'outbound', false),
  ('FREIGHT_INTL_SEA', 'logistics_transport', 'inbound_landed', true),
  ('CUSTOMS_DUTY', 'customs', 'inbound_landed', true),
  ('3PL_STORAGE_FEE', '3pl_billing', 'storage', false),
  ('DISPOSAL_FEE', '3pl_billing', 'returns', false),
  ('PLATFORM_FEE', 'platform_fee', 'period', false)) AS t(charge_type, charge_domain, cost_stage, capitalizable_flag)

-- name: basis_priority
SELECT * FROM (VALUES
  ('LAST_MILE_PARCEL', 'order_count', 0), ('LAST_MILE_PARCEL', 'line_count', 1),
  ('FREIGHT_INTL_SEA', 'weight', 0), ('FREIGHT_INTL_SEA', 'volume_cbm', 1),
  ('FREIGHT_INTL_SEA', 'value', 2), ('FREIGHT_INTL_SEA', 'qty', 3),
  ('DISPOSAL_FEE', 'line_count', 0), ('DISPOSAL_FEE', 'qty', 1),
  ('3PL_STORAGE_FEE', 'onhand_cbm_days', 0), ('3PL_STORAGE_FEE', 'onhand_qty_days', 1),
  ('PLATFORM_FEE', 'revenue', 0), ('PLATFORM_FEE', 'line_count', 1)) AS t(charge_type, basis, priority)

-- name: stock_days
SELECT strftime(m, '%Y-%m') AS period, s.warehouse_id, s.item_id, s.lot_id,
       CAST(sum(CAST(greatest(s.onhand_qty, 0) AS DECIMAL(18,4)) * (least(u, CAST(m + INTERVAL 1 MONTH AS DATE)) - greatest(s.snapshot_date, m))) AS DOUBLE) AS qty_days
FROM fact_inventory_snapshot s
JOIN (SELECT w, d, u, CAST(unnest(generate_series(date_trunc('month', d), date_trunc('month', u - 1), INTERVAL 1 MONTH)) AS DATE) AS m
      FROM (SELECT w, d, coalesce(lead(d) OVER (PARTITION BY w ORDER BY d), CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)) AS u
            FROM (SELECT DISTINCT warehouse_id AS w, snapshot_date AS d FROM fact_inventory_snapshot) x) y) k
  ON k.w = s.warehouse_id AND k.d = s.snapshot_date
GROUP BY 1, 2, 3, 4

-- name: item_volume
SELECT item_id, CAST(sum(CAST(volume_cbm AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS unit
FROM fact_shipment WHERE volume_cbm IS NOT NULL AND qty_shipped > 0 GROUP BY 1

-- name: storage_targets
SELECT c.invoice_no, c.invoice_line_no, c.charge_type, c.amount, c.period, c.currency,
       s.warehouse_id, CAST(NULL AS VARCHAR) AS channel_store_id, s.item_id, s.lot_id, CAST(NULL AS VARCHAR) AS shipment_id,
       s.qty_days AS qty, CAST(NULL AS DOUBLE) AS weight, s.qty_days * v.unit AS volume_cbm, true AS stored
FROM (SELECT a.*, w.warehouse_id IS NOT NULL AS own
      FROM fact_charge_actual a
      LEFT JOIN (SELECT DISTINCT period, warehouse_id FROM stock_days) w ON w.period = a.period AND w.warehouse_id = a.warehouse_id
      WHERE a.charge_type = '3PL_STORAGE_FEE') c
JOIN stock_days s ON s.period = c.period AND (s.warehouse_id = c.warehouse_id OR NOT c.own)
LEFT JOIN item_volume v ON v.item_id = s.item_id

-- name: charge_targets
SELECT * FROM storage_targets
UNION ALL
SELECT c.invoice_no, c.invoice_line_no, c.charge_type, c.amount, c.period, c.currency,
       s.warehouse_id, s.channel_store_id, s.item_id, s.lot_id, s.shipment_id,
       s.qty_shipped AS qty, s.weight, s.volume_cbm, false AS stored
FROM (SELECT a.*, w.warehouse_id IS NOT NULL AS own
      FROM fact_charge_actual a
      LEFT JOIN (SELECT DISTINCT strftime(ship_date, '%Y-%m') AS period, warehouse_id FROM fact_shipment) w
        ON w.period = a.period AND w.warehouse_id = a.warehouse_id
      WHERE a.charge_type <> '3PL_STORAGE_FEE') c
JOIN fact_shipment s
  ON strftime(s.ship_date, '%Y-%m') = c.period AND (s.warehouse_id = c.warehouse_id OR NOT c.own)

-- name: allocation_basis
SELECT invoice_no, invoice_line_no, charge_type, basis AS allocation_basis, basis_total, targets
FROM (
  SELECT b.*, row_number() OVER (PARTITION BY invoice_no, invoice_line_no, b.charge_type ORDER BY priority) AS rn
  FROM (
    SELECT invoice_no, invoice_line_no, charge_type, u.basis, count(*) AS targets,
           CAST(sum(CAST(coalesce(u.v, 0) AS DECIMAL(18,4))) AS DOUBLE) AS basis_total,
           bool_or(coalesce(u.v <> 0, false)) AS usable
    FROM (SELECT *, unnest([{'basis': 'qty', 'v': qty}, {'basis': 'value', 'v': qty}, {'basis': 'weight', 'v': weight},
                            {'basis': 'volume_cbm', 'v': volume_cbm}, {'basis': 'revenue', 'v': 1.0::DOUBLE},
                            {'basis': 'order_count', 'v': 1.0::DOUBLE}, {'basis': 'line_count', 'v': 1.0::DOUBLE},
                            {'basis': 'onhand_cbm_days', 'v': volume_cbm}, {'basis': 'onhand_qty_days', 'v': qty}]) AS u
          FROM charge_targets) t
    GROUP BY 1, 2, 3, 4) b
  JOIN basis_priority p ON b.charge_type = p.charge_type AND b.basis = p.basis
  WHERE usable) x
WHERE rn = 1

-- name: allocated_rows
SELECT *, CASE WHEN rn <= shortfall THEN q + 1 ELSE q END AS units_given
FROM (
  SELECT *, CAST(round_even(amount, 0) AS BIGINT) - sum(q) OVER line AS shortfall,
         row_number() OVER (PARTITION BY invoice_no, invoice_line_no, charge_type
           ORDER BY r DESC, warehouse_id, channel_store_id, item_id, lot_id, v, shipment_id) AS rn
  FROM (
    SELECT *, CAST((v * a) // den AS BIGINT) AS q, (v * a) % den AS r
    FROM (
      SELECT t.*, b.allocation_basis,
             CAST(coalesce(CASE b.allocation_basis WHEN 'weight' THEN weight WHEN 'volume_cbm' THEN volume_cbm
                    WHEN 'qty' THEN qty WHEN 'value' THEN qty WHEN 'onhand_qty_days' THEN qty
                    WHEN 'onhand_cbm_days' THEN CAST(CAST(volume_cbm AS DECIMAL(18,4)) AS DOUBLE) ELSE 1.0 END, 0) * 10000 AS HUGEINT) AS v,
             CAST(t.amount * 10000 AS HUGEINT) AS a,
             CAST(b.basis_total * 10000 AS HUGEINT) * 10000 AS den
      FROM charge_targets t
      JOIN allocation_basis b ON t.invoice_no = b.invoice_no AND t.invoice_line_no = b.invoice_line_no
        AND t.charge_type = b.charge_type) x) y
  WINDOW line AS (PARTITION BY invoice_no, invoice_line_no, charge_type)) z

-- name: largest_remainder
SELECT invoice_no, invoice_line_no, charge_type, CAST(max(round_even(amount, 0)) AS BIGINT) AS units,
       CAST(sum(q) AS BIGINT) AS floor_units, CAST(max(shortfall) AS BIGINT) AS shortfall,
       CAST(sum(units_given) AS BIGINT) AS allocated_units, CAST(sum(units_given - q) AS BIGINT) AS handed_out
FROM allocated_rows GROUP BY 1, 2, 3

-- name: mart_charge_allocated
SELECT period, r.charge_type, charge_domain, cost_stage, invoice_no, invoice_line_no, item_id, warehouse_id,
       channel_store_id, lot_id, allocation_basis, CAST(v AS DOUBLE) / 10000 AS basis_value,
       CAST(units_given AS DOUBLE) AS allocated_amount, CAST(units_given AS DOUBLE) AS allocated_amount_krw,
       currency, capitalizable_flag
FROM allocated_rows r JOIN charge_policy p ON r.charge_type = p.charge_type

-- name: unallocated_charges
SELECT c.invoice_no, c.invoice_line_no, c.charge_type, period, amount, currency,
       'no usable allocation basis for ' || c.charge_type AS reason
FROM fact_charge_actual c
ANTI JOIN allocation_basis b ON c.invoice_no = b.invoice_no AND c.invoice_line_no = b.invoice_line_no
  AND c.charge_type = b.charge_type

-- name: mart_pnl_revenue
SELECT period, item_id, channel_store_id, 'KR' AS country, gross_sales * rate AS gross_sales_krw,
       discounts * rate AS discounts_krw, refunds * rate AS refunds_krw, net_payout * rate AS net_revenue_krw,
       'settlement' AS source, CASE WHEN rate IS NOT NULL THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
FROM (SELECT s.*, CASE WHEN s.currency = 'KRW' THEN 1.0 ELSE x.rate_to_krw END AS rate
      FROM fact_settlement s
      LEFT JOIN fact_exchange_rate x ON s.period = x.period AND s.currency = x.currency) t

-- name: mart_pnl_cogs
SELECT n.period, n.item_id, channel_store_id, 'KR' AS country, qty_shipped, qty_returned,
       qty_shipped - qty_returned AS qty_net, unit_cost_krw,
       (qty_shipped - qty_returned) * unit_cost_krw AS cogs_krw,
       CASE WHEN unit_cost_krw IS NOT NULL THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
FROM (
  SELECT s.*, coalesce(r.qty, 0.0) AS qty_returned, last_day(CAST(s.period || '-01' AS DATE)) AS d
  FROM (SELECT strftime(ship_date, '%Y-%m') AS period, item_id, coalesce(channel_store_id, 'UNKNOWN') AS channel_store_id,
               CAST(sum(CAST(qty_shipped AS DECIMAL(18,4))) AS DOUBLE) AS qty_shipped
        FROM fact_shipment WHERE channel_order_id IS NOT NULL GROUP BY 1, 2, 3) s
  LEFT JOIN (SELECT strftime(return_date, '%Y-%m') AS period, item_id,
                    CAST(sum(CAST(qty_returned AS DECIMAL(18,4))) AS DOUBLE) AS qty
             FROM fact_return WHERE channel_order_id IS NOT NULL GROUP BY 1, 2) r
    ON s.period = r.period AND s.item_id = r.item_id) n
ASOF LEFT JOIN unit_cost c ON n.item_id = c.item_id AND n.d >= c.effective_from

-- name: revenue_by_grain
SELECT period, item_id, channel_store_id, country,
       CAST(sum(CAST(net_revenue_krw AS DECIMAL(18,4))) AS DOUBLE) AS net_revenue_krw,
       CASE WHEN bool_and(coverage_flag = 'ACTUAL') THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
FROM mart_pnl_revenue GROUP BY 1, 2, 3, 4

-- name: mart_pnl_gross_margin
SELECT *, net_revenue_krw - cogs_krw AS gross_margin_krw,
       CASE WHEN net_revenue_krw <> 0 THEN (net_revenue_krw - cogs_krw) / net_revenue_krw ELSE 0.0 END AS gross_margin_pct
FROM (
  SELECT coalesce(r.period, c.period) AS period, coalesce(r.item_id, c.item_id) AS item_id,
         coalesce(r.channel_store_id, c.channel_store_id) AS channel_store_id,
         coalesce(r.country, c.country, 'KR') AS country,
         coalesce(r.net_revenue_krw, 0.0) AS net_revenue_krw, coalesce(c.cogs_krw, 0.0) AS cogs_krw,
         CASE WHEN coalesce(r.coverage_flag, 'PARTIAL') = 'ACTUAL' AND coalesce(c.coverage_flag, 'PARTIAL') = 'ACTUAL'
              THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
  FROM revenue_by_grain r
  FULL JOIN mart_pnl_cogs c
    ON r.period = c.period AND r.item_id = c.item_id AND r.channel_store_id = c.channel_store_id) x

-- name: mart_pnl_variable_cost
SELECT period, coalesce(item_id, 'ALL') AS item_id, coalesce(channel_store_id, 'ALL') AS channel_store_id,
       'KR' AS country, charge_domain, charge_type,
       CAST(sum(CAST(allocated_amount_krw AS DECIMAL(18,4))) AS DOUBLE) AS allocated_amount_krw,
       'ACTUAL' AS coverage_flag
FROM mart_charge_allocated GROUP BY ALL

-- name: mart_pnl_contribution
SELECT period, item_id, channel_store_id, country, gross_margin_krw, vc AS total_variable_cost_krw,
       gross_margin_krw - vc AS contribution_krw,
       CASE WHEN net_revenue_krw <> 0 THEN (gross_margin_krw - vc) / net_revenue_krw ELSE 0.0 END AS contribution_pct,
       coverage_flag
FROM (
  SELECT g.*, coalesce(v.vc, 0.0) AS vc
  FROM mart_pnl_gross_margin g
  LEFT JOIN (SELECT period, item_id, channel_store_id,
                    CAST(sum(CAST(allocated_amount_krw AS DECIMAL(18,4))) AS DOUBLE) AS vc
             FROM mart_pnl_variable_cost GROUP BY 1, 2, 3) v
    ON g.period = v.period AND g.item_id = v.item_id AND g.channel_store_id = v.channel_store_id) x

-- name: mart_pnl_operating_profit
SELECT period, item_id, channel_store_id, country, contribution_krw, 0.0::DOUBLE AS fixed_cost_krw,
       contribution_krw AS operating_profit_krw, contribution_pct AS operating_profit_pct, coverage_flag
FROM mart_pnl_contribution

-- name: mart_pnl_waterfall
SELECT period, metric_name, metric_order, CAST(coalesce(sum(CAST(amt AS DECIMAL(18,4))), 0) AS DOUBLE) AS amount_krw
FROM (
  SELECT period, '매출 (Net Revenue)' AS metric_name, 1 AS metric_order, net_revenue_krw AS amt FROM mart_pnl_revenue
  UNION ALL SELECT period, '매출원가 (COGS)', 2, cogs_krw FROM mart_pnl_cogs
  UNION ALL SELECT period, '매출총이익 (Gross Margin)', 3, gross_margin_krw FROM mart_pnl_gross_margin
  UNION ALL SELECT period, '변동비 (Variable Cost)', 4, allocated_amount_krw FROM mart_pnl_variable_cost
  UNION ALL SELECT period, '공헌이익 (Contribution)', 5, contribution_krw FROM mart_pnl_contribution
  UNION ALL SELECT period, '영업이익 (Operating Profit)', 6, operating_profit_krw FROM mart_pnl_operating_profit) t
GROUP BY 1, 2, 3

-- name: versioned_join
SELECT channel_order_id, line_no, o.item_id, order_date, qty_ordered, unit_cost_krw
FROM fact_order o
ASOF JOIN unit_cost c ON o.item_id = c.item_id AND o.order_date >= c.effective_from

-- name: profitability_ranking
SELECT *, CAST(row_number() OVER (PARTITION BY period
            ORDER BY coalesce(contribution_krw, gross_margin_krw, net_revenue_krw) DESC NULLS FIRST,
                     item_id, channel_store_id, country) AS INTEGER) AS rank_by_contribution
FROM (
  SELECT r.period, r.item_id, r.channel_store_id, r.country, r.net_revenue_krw, g.gross_margin_krw,
         g.gross_margin_pct, c.contribution_krw, c.contribution_pct,
         CASE WHEN r.coverage_flag = 'ACTUAL' AND coalesce(g.coverage_flag, 'PARTIAL') = 'ACTUAL'
               AND coalesce(c.coverage_flag, 'PARTIAL') = 'ACTUAL' THEN 'ACTUAL' ELSE 'PARTIAL' END AS coverage_flag
  FROM revenue_by_grain r
  LEFT JOIN mart_pnl_gross_margin g ON r.period = g.period AND r.item_id = g.item_id
    AND r.channel_store_id = g.channel_store_id AND r.country = g.country
  LEFT JOIN mart_pnl_contribution c ON r.period = c.period AND r.item_id = c.item_id
    AND r.channel_store_id = c.channel_store_id AND r.country = c.country) x

-- name: pnl_coverage_rows
SELECT period, mart, count(*) FILTER (WHERE coverage_flag = 'ACTUAL') AS actual_count,
       count(*) FILTER (WHERE coverage_flag = 'PARTIAL') AS partial_count, count(*) AS total_count,
       count(*) FILTER (WHERE coverage_flag = 'ACTUAL') / count(*) AS actual_ratio
FROM (
  SELECT period, 'revenue' AS mart, coverage_flag FROM mart_pnl_revenue
  UNION ALL SELECT period, 'cogs', coverage_flag FROM mart_pnl_cogs
  UNION ALL SELECT period, 'gross_margin', coverage_flag FROM mart_pnl_gross_margin
  UNION ALL SELECT period, 'variable_cost', coverage_flag FROM mart_pnl_variable_cost
  UNION ALL SELECT period, 'contribution', coverage_flag FROM mart_pnl_contribution
  UNION ALL SELECT period, 'operating_profit', coverage_flag FROM mart_pnl_operating_profit) t
GROUP BY 1, 2
