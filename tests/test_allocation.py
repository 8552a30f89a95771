"""Allocation against a plain restatement, with ties, hot warehouses and odd amounts."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from frames import catalog, frame, rows

from ledgerloom import Policy
from ledgerloom.operators import allocation


def restated(charge, ships, basis, decimals):
    """Floor every share, then one more unit to the largest remainders in key order."""
    scoped = [s for s in ships if s["warehouse_id"] == charge["warehouse_id"]] or ships
    value = {"weight": lambda s: s["weight"] or 0.0, "qty": lambda s: s["qty_shipped"]}.get(basis, lambda s: 1.0)
    weights = [Fraction(str(value(s))) for s in scoped]
    total, amount, factor = sum(weights), Fraction(str(charge["amount"])), 10 ** decimals
    raw = [w / total * amount * factor for w in weights]
    units = [r.numerator // r.denominator for r in raw]
    short = round(amount * factor) - sum(units)
    order = sorted(range(len(scoped)), key=lambda i: (
        -(raw[i] - units[i]), scoped[i]["warehouse_id"], scoped[i]["channel_store_id"] or "", scoped[i]["item_id"],
        scoped[i]["lot_id"], weights[i]))
    for i in order[:max(short, 0)]:
        units[i] += 1
    return Counter(
        (charge["invoice_no"], s["warehouse_id"], s["channel_store_id"], s["item_id"], s["lot_id"], u / factor)
        for s, u in zip(scoped, units))


def shipments(n, seed, hot=False):
    pick = random.Random(seed)
    return [{
        "shipment_id": f"S{i}", "ship_date": "2024-01-05", "warehouse_id": "W1" if hot and i % 3 else f"W{pick.randrange(3)}",
        "item_id": str(pick.randrange(6)), "lot_id": f"L{pick.randrange(2)}",
        "channel_store_id": pick.choice(["A", "B", None]), "qty_shipped": float(pick.randrange(1, 9)),
        "weight": pick.choice([None, 0.5, 1.25, 3.0]), "volume_cbm": 0.1, "channel_order_id": "O",
    } for i in range(n)]


def charge(no, kind, amount, warehouse=None, currency="KRW"):
    return {"invoice_no": f"I{no}", "invoice_line_no": 1, "charge_type": kind, "amount": amount, "currency": currency,
            "period": "2024-01", "warehouse_id": warehouse}


BASIS = {"LAST_MILE_PARCEL": "order_count", "FREIGHT_INTL_SEA": "weight", "DOMESTIC_TRUCKING": "order_count",
         "CUSTOMS_DUTY": "weight", "PLATFORM_FEE": "revenue"}


@pytest.mark.parametrize("decimals, seed, hot, window, few", [
    (0, 1, False, 0, 10**6), (0, 2, True, 0, 0), (2, 3, False, 0, 10**6), (0, 2, True, 10**6, 10**6), (2, 4, False, 10**6, 0)])
def test_matches_restatement(spark, monkeypatch, decimals, seed, hot, window, few):
    """Both ways to place the extra units, with and without broadcast lines."""
    monkeypatch.setattr(allocation, "WINDOW_CLASSES", window)
    monkeypatch.setattr(allocation, "BROADCAST_LINES", few)
    pick = random.Random(seed)
    ships = shipments(150, seed, hot)
    charges = [charge(i, pick.choice(list(BASIS)), pick.choice([1000.0, 500.0, 999999.0, 333.0, 7.0, 1234.56, -250.0]),
                      pick.choice([None, "W0", "W1", "nowhere"])) for i in range(12)]
    cat = catalog(spark, Policy(allocation_decimals=decimals, allocation_scope="all"), fact_shipment=ships, fact_charge_actual=charges)
    got = Counter(
        (r.invoice_no, r.warehouse_id, r.channel_store_id, r.item_id, r.lot_id, r.allocated_amount)
        for r in cat["mart_charge_allocated"].collect())
    want = Counter()
    for c in charges:
        want += restated(c, ships, BASIS[c["charge_type"]], decimals)
    assert got == want
    assert all(r.tied or abs(r.delta) < 1 for r in cat["reco_charges_tieout"].collect())


def test_whole_amounts_are_conserved(spark):
    charges = [charge(i, "LAST_MILE_PARCEL", a) for i, a in enumerate((1000.0, 500.0, 999999.0, 333.0))]
    cat = catalog(spark, fact_shipment=shipments(7, 5), fact_charge_actual=charges)
    assert [r.tied for r in cat["reco_charges_tieout"].collect()] == [True]


def test_no_shipments_keeps_one_target_and_no_basis_is_reported(spark):
    cat = catalog(spark, fact_charge_actual=[
        charge(1, "LAST_MILE_PARCEL", 1000.0), charge(2, "3PL_STORAGE_FEE", 10.0), charge(3, "MYSTERY", 10.0)])
    assert [(r.item_id, r.warehouse_id, r.allocated_amount) for r in cat["mart_charge_allocated"].collect()] == [
        ("UNALLOCATED", "UNKNOWN", 1000.0)]
    reasons = {r.invoice_no: r.reason for r in cat["unallocated_charges"].collect()}
    assert reasons == {"I2": "no usable allocation basis for 3PL_STORAGE_FEE", "I3": "unknown charge type MYSTERY"}


def test_foreign_charge_uses_rate_or_default(spark):
    tables = dict(fact_shipment=shipments(4, 9), fact_charge_actual=[charge(1, "PG_FEE", 100.0, currency="USD")])
    plain = catalog(spark, **tables)
    rated = catalog(spark, **tables, fact_exchange_rate=[{"period": "2024-01", "currency": "USD", "rate_to_krw": 1300.0}])
    total = [sum(r.allocated_amount_krw for r in c["mart_charge_allocated"].collect()) for c in (plain, rated)]
    assert total == [100.0, 130000.0]


def test_period_scope(spark):
    ships = [dict(s, ship_date="2024-02-05") for s in shipments(4, 1)] + shipments(3, 2)
    cat = catalog(spark, Policy(allocation_scope="period"), fact_shipment=ships,
                  fact_charge_actual=[charge(1, "PG_FEE", 100.0)])
    assert cat["mart_charge_allocated"].count() == 3


def test_large_counts_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(allocation, "PIECE", 10)
    df = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0), ("d", 10)], "k string, n bigint")
    assert Counter(r.k for r in allocation.repeat_rows(df, "n").collect()) == Counter({"a": 25, "b": 3, "d": 10})


def test_policy_is_sound():
    assert Policy().problems() == []
    bad = Policy(basis_overrides={"NOPE": ["weight", "colour"]})
    assert len(bad.problems()) == 2


def snapshot(day, item, lot, qty, warehouse="W0"):
    return {"snapshot_date": day, "warehouse_id": warehouse, "item_id": item, "lot_id": lot, "onhand_qty": qty}


STOCK = [
    snapshot("2023-12-30", "a", "L", 10.0), snapshot("2023-12-30", "b", "L", 1.0), snapshot("2024-01-11", "a", "L", 4.0),
    snapshot("2024-01-11", "c", None, -5.0), snapshot("2024-01-20", "c", None, 2.0), snapshot("2024-01-05", "a", "L", 3.0, "W1")]


def test_stock_days_are_cut_at_month_borders(spark):
    found = allocation.stock_days(frame(spark, "fact_inventory_snapshot", STOCK))
    assert rows(found, "period", "warehouse_id", "item_id", "qty_days") == [
        ("2023-12", "W0", "a", 20.0), ("2023-12", "W0", "b", 2.0), ("2024-01", "W0", "a", 10.0 * 10 + 4.0 * 9), ("2024-01", "W0", "b", 10.0),
        ("2024-01", "W0", "c", 2.0 * 12), ("2024-01", "W1", "a", 3.0 * 27)]


def test_storage_fees_follow_stock(spark):
    tables = dict(fact_inventory_snapshot=STOCK, fact_shipment=shipments(6, 3), fact_charge_actual=[
        charge(1, "3PL_STORAGE_FEE", 170.0, "W0"), charge(2, "3PL_STORAGE_FEE", 100.0, "nowhere"), charge(3, "PG_FEE", 60.0)])
    cat = catalog(spark, **tables)
    # No shipment tells the volume of these items, so quantities weigh.
    assert rows(cat["allocation_basis"], "invoice_no", "allocation_basis", "basis_total", "targets")[:2] == [
        ("I1", "onhand_qty_days", 170.0, 3), ("I2", "onhand_qty_days", 251.0, 4)]
    parts = {r.item_id: r.allocated_amount for r in cat["mart_charge_allocated"].collect() if r.invoice_no == "I1"}
    assert parts == {"a": 136.0, "b": 10.0, "c": 24.0}
    assert all(r.tied for r in cat["reco_charges_tieout"].collect()) and cat["unallocated_charges"].count() == 0
    every = catalog(spark, Policy(allocation_scope="all"), **tables)
    assert rows(every["allocation_basis"], "invoice_no", "basis_total")[0] == ("I1", 192.0)


def test_volume_weighs_where_shipments_tell_it(spark):
    ships = [dict(s, item_id="a", qty_shipped=2.0, volume_cbm=0.5) for s in shipments(2, 3)]
    cat = catalog(spark, fact_inventory_snapshot=STOCK, fact_shipment=ships, fact_charge_actual=[charge(1, "3PL_STORAGE_FEE", 34.0, "W0")])
    assert rows(cat["allocation_basis"], "allocation_basis", "basis_total") == [("onhand_cbm_days", 34.0)]
    assert {r.item_id: r.allocated_amount for r in cat["mart_charge_allocated"].collect()} == {"a": 34.0, "b": 0.0, "c": 0.0}
