"""Expected values on small hand-made inputs."""

import datetime as dt
import math

import pytest
from frames import catalog, frame, rows
from pyspark.sql import functions as F

from ledgerloom import Policy


def ship(i, day, item="SKU", store="A", qty=10.0, order="O1", **more):
    return {"shipment_id": f"S{i}", "ship_date": day, "warehouse_id": "W1", "item_id": item, "lot_id": "L",
            "qty_shipped": qty, "channel_order_id": order, "channel_store_id": store, "source_system": "WMS", **more}


def cost(component, start, value, item="SKU"):
    return {"item_id": item, "cost_component": component, "effective_from": start, "cost_per_unit_krw": value}


def settle(line, currency="KRW", net=100.0, period="2024-01", item="SKU", store="A"):
    return {"settlement_id": "T", "line_no": line, "period": period, "channel_store_id": store, "item_id": item,
            "currency": currency, "gross_sales": net, "net_payout": net}


def test_cost_components_are_summed_before_the_join(spark):
    cat = catalog(spark, fact_shipment=[ship(1, "2024-01-10")], fact_cost_structure=[
        cost("M", "2024-01-01", 500.0), cost("L", "2024-01-01", 300.0), cost("O", "2024-01-01", 200.0)])
    assert rows(cat["mart_pnl_cogs"], "unit_cost_krw", "cogs_krw", "coverage_flag") == [(1000.0, 10000.0, "ACTUAL")]


def test_each_month_takes_its_own_cost(spark):
    cat = catalog(spark, fact_shipment=[ship(1, "2024-01-10"), ship(2, "2024-02-10")], fact_cost_structure=[
        cost("M", "2024-01-01", 1000.0), cost("M", "2024-02-01", 1200.0)])
    assert rows(cat["mart_pnl_cogs"], "period", "unit_cost_krw") == [("2024-01", 1000.0), ("2024-02", 1200.0)]


def test_missing_cost_stays_unknown_down_the_chain(spark):
    cat = catalog(spark, fact_shipment=[ship(1, "2024-01-10")], fact_settlement=[settle(1)])
    assert rows(cat["mart_pnl_cogs"], "cogs_krw", "coverage_flag") == [(None, "PARTIAL")]
    for mart in ("gross_margin", "contribution", "operating_profit"):
        assert rows(cat[f"mart_pnl_{mart}"], "coverage_flag") == [("PARTIAL",)]


def test_transfers_do_not_count_as_sales(spark):
    back = {"return_id": "R1", "return_date": "2024-01-20", "item_id": "SKU", "qty_returned": 3.0}
    cat = catalog(
        spark, fact_shipment=[ship(1, "2024-01-10"), ship(2, "2024-01-11", order=None)],
        fact_return=[back, {**back, "return_id": "R2", "channel_order_id": "O1", "qty_returned": 1.0}],
        fact_cost_structure=[cost("M", "2024-01-01", 10.0)])
    assert rows(cat["mart_pnl_cogs"], "qty_shipped", "qty_returned", "cogs_krw") == [(10.0, 1.0, 90.0)]


def test_returns_by_store_option(spark):
    back = {"return_id": "R", "return_date": "2024-01-20", "item_id": "SKU", "qty_returned": 4.0, "channel_order_id": "O2"}
    tables = dict(
        fact_shipment=[ship(1, "2024-01-10"), ship(2, "2024-01-11", store="B", order="O2")], fact_return=[back],
        fact_order=[{"channel_order_id": "O2", "line_no": 1, "channel_store_id": "B"}])
    assert rows(catalog(spark, **tables)["mart_pnl_cogs"], "channel_store_id", "qty_net") == [("A", 6.0), ("B", 6.0)]
    by_store = catalog(spark, Policy(returns_by_store=True), **tables)
    assert rows(by_store["mart_pnl_cogs"], "channel_store_id", "qty_net") == [("A", 10.0), ("B", 6.0)]


def test_missing_rate_gives_null_and_partial(spark):
    cat = catalog(spark, fact_settlement=[settle(1, "USD"), settle(2, "KRW"), settle(3, "EUR")],
                  fact_exchange_rate=[{"period": "2024-01", "currency": "EUR", "rate_to_krw": 1400.0}])
    assert rows(cat["mart_pnl_revenue"], "net_revenue_krw", "coverage_flag") == [
        (100.0, "ACTUAL"), (140000.0, "ACTUAL"), (None, "PARTIAL")]


def test_margin_joins_once_per_grain(spark):
    cat = catalog(spark, fact_shipment=[ship(1, "2024-01-10")], fact_settlement=[settle(1), settle(2)],
                  fact_cost_structure=[cost("M", "2024-01-01", 1.0)])
    assert rows(cat["mart_pnl_gross_margin"], "net_revenue_krw", "cogs_krw") == [(200.0, 10.0)]


def lot(day="2024-01-20", item="SKU", lot="A", onhand=100.0, expiry=None, **more):
    return {"snapshot_date": day, "warehouse_id": "W1", "item_id": item, "lot_id": lot, "onhand_qty": onhand,
            "expiry_date": expiry, **more}


def test_sellable_split(spark):
    cat = catalog(
        spark,
        dim_item=[{"item_id": "Q", "item_type": "FG", "qc_required_flag": True},
                  {"item_id": "SKU", "item_type": "RM", "shelf_life_days": 365}],
        fact_receipt=[{"receipt_id": "r", "item_id": "SKU", "lot_id": "M", "mfg_date": "2023-12-01"}],
        fact_inventory_snapshot=[
            lot(lot="old", expiry="2024-01-01"), lot(lot="near", expiry="2024-01-30"), lot(lot="far", expiry="2024-06-01"),
            lot(lot="held", expiry="2024-06-01", hold_flag=True), lot(lot="M"), lot(item="Q", lot="qc", qc_status=None),
            lot(item="Q", lot="ok", qc_status="RELEASED")])
    got = {r.lot_id: (r.expired_qty, r.blocked_qty, r.sellable_qty) for r in cat["sellable_qty"].collect()}
    assert got == {
        "old": (100.0, 0.0, 0.0), "near": (0.0, 100.0, 0.0), "far": (0.0, 0.0, 100.0), "held": (0.0, 100.0, 0.0),
        "M": (0.0, 0.0, 100.0), "qc": (0.0, 100.0, 0.0), "ok": (0.0, 0.0, 100.0)}
    dates = {r.lot_id: r.final_expiry_date for r in cat["final_expiry"].collect()}
    assert dates["M"] == dt.date(2024, 11, 30)


def test_fefo_order_and_unranked(spark):
    cat = catalog(spark, fact_inventory_snapshot=[
        lot(lot="C", expiry="2024-09-01"), lot(lot="A", expiry="2024-03-01"), lot(lot="B", expiry="2024-06-01"),
        lot(lot="N"), lot(lot="B2", expiry="2024-06-01")])
    assert rows(cat["fefo_rank"], "lot_id", "fefo_rank") == [("A", 1), ("B", 2), ("B2", 3), ("C", 4), ("N", None)]


def test_stockout_infinite_without_demand(spark):
    cat = catalog(spark, fact_inventory_snapshot=[lot("2024-01-19", onhand=5.0), lot("2024-01-20", onhand=50.0)])
    [row] = cat["mart_stockout_risk"].collect()
    assert (row.sellable_qty, math.isinf(row.days_of_cover), row.risk_flag) == (50.0, True, False)


def test_movement_delta(spark):
    cat = catalog(
        spark, fact_inventory_snapshot=[lot("2024-01-19"), lot("2024-01-20", onhand=115.0), lot("2024-01-22", onhand=1.0)],
        fact_receipt=[{"receipt_id": "r", "receipt_date": "2024-01-20", "warehouse_id": "W1", "item_id": "SKU",
                       "qty_received": 50.0}],
        fact_shipment=[ship(1, "2024-01-20", qty=30.0)])
    assert rows(cat["reco_inventory_movement"], "expected_onhand", "delta", "severity") == [(120.0, -5.0, "high")]


@pytest.mark.parametrize("order_day, expected", [("2024-01-15", 5000.0), ("2024-02-10", 5500.0), ("2023-06-01", None)])
def test_as_of_join(spark, order_day, expected):
    cat = catalog(
        spark, fact_order=[{"channel_order_id": "O", "line_no": 1, "order_date": order_day, "item_id": "SKU"}],
        fact_cost_structure=[cost("M", "2024-01-01", 5000.0), cost("M", "2024-02-01", 5500.0)])
    assert [r.unit_cost_krw for r in cat["versioned_join"].collect()] == ([expected] if expected else [])


def test_week_starts_on_monday_and_null_order_counts(spark):
    cat = catalog(
        spark, fact_order=[{"channel_order_id": "O1", "line_no": 1, "order_date": "2024-01-17", "channel_store_id": "A"}],
        fact_shipment=[ship(1, "2024-01-18"), ship(2, "2024-01-18", order=None)])
    assert rows(cat["mart_service_level"], "week_start", "shipped_on_time") == [(dt.date(2024, 1, 15), 1)]
    assert rows(cat["mart_shipment_daily"], "unique_orders", "weight") == [(2, 0.0)]


def test_anomaly_needs_seven_points(spark):
    def run(values):
        cat = catalog(spark, fact_shipment=[ship(i, f"2024-01-{i + 1:02d}", qty=v) for i, v in enumerate(values)])
        return rows(cat["anomaly_shipments"], "current_value", "severity")

    assert run([10.0] * 5 + [500.0]) == []
    assert run([10.0, 11.0] * 6 + [500.0]) == [(500.0, "CRITICAL")]
    assert run([10.0] * 12) == []


def test_period_reopen_and_force_close(spark):
    cat = catalog(spark, period_events=[
        {"period": "2024-01", "event": "close", "at": "2024-02-01", "actor": "a"},
        {"period": "2024-02", "event": "close", "at": "2024-03-01", "actor": "a"},
        {"period": "2024-02", "event": "reopen", "at": "2024-03-05", "actor": "b"}])
    assert rows(cat["closed_periods"]) == [("2024-01",)]


def test_issue_ids_repeat_and_effectiveness_matches(spark):
    cat = catalog(spark, fact_inventory_snapshot=[lot("2024-02-20", expiry="2024-01-01")])
    assert rows(cat["mart_constraint_effectiveness"], "before_value", "after_value", "delta") == [(100.0, 0.0, -100.0)]
    again = catalog(spark, fact_inventory_snapshot=[lot("2024-02-20", expiry="2024-01-01")])
    assert rows(cat["signal_expired_value"], "signal_id") == rows(again["signal_expired_value"], "signal_id")


def test_result_does_not_depend_on_partitioning(spark):
    def total(parts):
        cat = catalog(spark)
        cat["fact_shipment"] = spark.range(4000).select(
            F.concat(F.lit("S"), "id").alias("shipment_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int"))
            .alias("ship_date"), F.lit("W1").alias("warehouse_id"), (F.col("id") % 7).cast("string").alias("item_id"),
            F.lit("L").alias("lot_id"), (F.col("id") % 13 / 3).alias("qty_shipped"), F.lit(0.1).alias("weight"),
            F.lit(0.3).alias("volume_cbm"), F.col("id").cast("string").alias("channel_order_id"),
            F.lit("A").alias("channel_store_id")).repartition(parts)
        return rows(cat["mart_shipment_daily"])

    assert total(1) == total(7)


def test_filters_read_the_months_asked_for(spark, tmp_path):
    import datetime as dt
    import re

    from ledgerloom.plans.dashboards import publish, read_published

    ships = [dict(shipment_id=f"S{m}", ship_date=f"2024-{m:02d}-05", warehouse_id="W1", item_id="A", channel_store_id="S", qty_shipped=float(m),
                  channel_order_id=f"O{m}") for m in range(1, 7)]
    cat = catalog(spark, fact_shipment=ships)
    path, _ = publish(cat, "mart_shipment_daily", str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("_month=*"))) == 6 and path == str(tmp_path / "m")
    found = read_published(cat, "mart_shipment_daily", dt.date(2024, 2, 1), dt.date(2024, 3, 31), warehouse_id="W1")
    assert rows(found, "ship_date", "qty_shipped") == [(dt.date(2024, 2, 5), 2.0), (dt.date(2024, 3, 5), 3.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[_month#\d+ IN \(2024-02,2024-03\)\]", plan), plan
    assert read_published(cat, "mart_shipment_daily").count() == 6
