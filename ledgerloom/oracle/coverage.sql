-- name: period_events
SELECT period, event, e + CAST(days AS INTEGER) AS moment, actor
FROM (SELECT DISTINCT strftime(order_date, '%Y-%m') AS period, last_day(order_date) AS e FROM fact_order) p,
     (VALUES ('close', 10, 'controller', 1), ('reopen', 20, 'auditor', 2), ('close', 30, 'force', 3)) AS v(event, days, actor, step)
WHERE year(e) <= 1998 AND (step = 1 OR (step = 2 AND month(e) IN (5, 10)) OR (step = 3 AND month(e) = 10))

-- name: period_state
SELECT period, arg_max(event = 'close', moment) AS lock_flag, max(moment) FILTER (WHERE event = 'close') AS closed_at,
       arg_max(actor, moment) AS last_actor
FROM period_events GROUP BY 1

-- name: period_gate
SELECT channel_order_id, line_no, strftime(order_date, '%Y-%m') AS period, s.period IS NULL AS accepted
FROM fact_order o
LEFT JOIN (SELECT period FROM period_state WHERE lock_flag) s ON s.period = strftime(o.order_date, '%Y-%m')

-- name: mart_coverage_period
SELECT period, domain, CASE WHEN n >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage_rate, n AS included_rows,
       CAST(CASE WHEN n >= 1 THEN 0 ELSE 1 - n END AS BIGINT) AS missing_rows,
       CASE WHEN n >= 1 THEN 'OK'
            WHEN CASE WHEN closed THEN need_closed ELSE need_open END THEN 'CRITICAL' ELSE 'INFO' END AS severity,
       closed AS is_closed_period
FROM (
  SELECT p.period, d.domain, need_open, need_closed, s.period IS NOT NULL AS closed,
         CAST(CASE WHEN d.domain = 'cost_structure' THEN (SELECT count(*) FROM fact_cost_structure)
              ELSE coalesce(c.n, 0) END AS BIGINT) AS n
  FROM (SELECT DISTINCT strftime(order_date, '%Y-%m') AS period FROM fact_order
        UNION SELECT strftime(ship_date, '%Y-%m') FROM fact_shipment
        UNION SELECT period FROM fact_charge_actual
        UNION SELECT period FROM fact_settlement) p
  CROSS JOIN (VALUES ('fx_rate', true, true), ('revenue_settlement', false, false), ('logistics_transport', false, true),
                     ('customs', false, false), ('3pl_billing', false, false), ('cost_structure', false, true))
    AS d(domain, need_open, need_closed)
  LEFT JOIN (SELECT 'fx_rate' AS domain, period, count(*) AS n FROM fact_exchange_rate GROUP BY 2
             UNION ALL SELECT 'revenue_settlement', period, count(*) FROM fact_settlement GROUP BY 2
             UNION ALL SELECT charge_domain, period, count(*)
                       FROM fact_charge_actual a JOIN charge_policy b ON a.charge_type = b.charge_type GROUP BY 1, 2) c
    ON c.domain = d.domain AND c.period = p.period
  LEFT JOIN (SELECT period FROM period_state WHERE lock_flag) s ON s.period = p.period) x

-- name: closed_period_gaps
SELECT period, domain, 'REQUIRED domain ''' || domain || ''' has insufficient data for closed period ''' || period
         || ''' (found ' || included_rows || ' rows, need >= 1)' AS message
FROM mart_coverage_period
WHERE is_closed_period AND coverage_rate < 1 AND domain IN ('fx_rate', 'logistics_transport', 'cost_structure')

-- name: adjustment_log
SELECT row_number() OVER (ORDER BY period, changed_on, business_key, old_value, new_value) AS adjustment_id, *
FROM (
  SELECT strftime(e.ship, '%Y-%m') AS period, k.l_shipdate AS changed_on, 'fact_order' AS table_name,
         e.l_orderkey || '|' || e.l_linenumber AS business_key, 'qty_ordered' AS field_name,
         CAST(CAST(e.l_quantity AS BIGINT) AS VARCHAR) AS old_value,
         CAST(CAST(k.l_quantity AS BIGINT) AS VARCHAR) AS new_value, 'late correction' AS reason
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS ship FROM lineitem) e
  JOIN li k ON e.l_orderkey = k.l_orderkey AND e.l_linenumber = k.l_linenumber
  WHERE e.l_quantity <> k.l_quantity) c
WHERE period IN (SELECT period FROM period_state WHERE lock_flag)
