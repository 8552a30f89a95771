"""Versioned facts: merging keeps what it replaces, undoing brings it back."""

import datetime as dt
import random
import re

from frames import SCHEMAS, frame, rows
from pyspark.sql import functions as F

from ledgerloom import Catalog
from ledgerloom.plans.rollback import MEASURES, rollback
from ledgerloom.sources import history
from ledgerloom.sources.contracts import CONTRACTS

COLUMNS = ["shipment_id", "item_id", "lot_id", "ship_date", "qty_shipped", "load_batch_id"]


def shipments(spark, *data):
    return frame(spark, "fact_shipment", [
        dict(shipment_id=i, item_id="A", lot_id=lot, ship_date=day, qty_shipped=float(q), warehouse_id="W", channel_order_id="O", channel_store_id="S")
        for i, lot, day, q in data])


def state(spark, path):
    return rows(history.current(spark, path), *COLUMNS)


def test_undo_brings_replaced_rows_back(spark, tmp_path):
    path = str(tmp_path / "fact_shipment")
    history.merge_batch(shipments(spark, ("s1", "L", "2024-01-05", 1), ("s2", None, "2024-01-06", 2), ("s3", "L", "2024-02-01", 3)), "fact_shipment", path, 1)
    first = state(spark, path)
    # s1 moves to another month, s2 (NULL lot) changes, s4 is new.
    second = shipments(spark, ("s1", "L", "2024-03-05", 9), ("s2", None, "2024-01-06", 8), ("s4", "L", "2024-01-07", 4))
    history.merge_batch(second, "fact_shipment", path, 2)
    assert [(r[0], r[4], r[5]) for r in state(spark, path)] == [("s1", 9.0, 2), ("s2", 8.0, 2), ("s3", 3.0, 1), ("s4", 4.0, 2)]
    again = state(spark, path)
    history.merge_batch(second, "fact_shipment", path, 2)
    assert state(spark, path) == again and history.versions(spark, path).count() == 6
    assert rows(history.as_of(spark, path, 1), *COLUMNS) == first
    history.merge_batch(shipments(spark, ("s1", "L", "2024-01-09", 7)), "fact_shipment", path, 3)
    history.undo_batches(spark, "fact_shipment", path, [2])  # one in the middle: batch 3 still holds s1
    assert [(r[0], r[4]) for r in state(spark, path)] == [("s1", 7.0), ("s2", 2.0), ("s3", 3.0)]
    history.undo_batches(spark, "fact_shipment", path, [3])
    assert state(spark, path) == first
    assert not (tmp_path / "fact_shipment" / "_open=true" / "_month=2024-03").exists()
    history.undo_batches(spark, "fact_shipment", path, [77])
    history.merge_batch(shipments(spark), "fact_shipment", path, 4)
    assert state(spark, path) == first


def test_only_open_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "f")
    history.merge_batch(shipments(spark, ("s1", "L", "2024-01-05", 1)), "fact_shipment", path, 1)
    history.merge_batch(shipments(spark, ("s1", "L", "2024-01-05", 2)), "fact_shipment", path, 2)
    plan = history.current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_open", plan)


def test_any_order_of_merges_and_undos_equals_a_replay(spark, tmp_path):
    rng = random.Random(6)
    path = str(tmp_path / "f")
    batches = {b: [(f"s{rng.randrange(6)}", rng.choice(["L", None]), f"2024-0{rng.randrange(1, 4)}-01", rng.randrange(99)) for _ in range(4)] for b in range(1, 6)}
    batches = {b: list({(r[0], r[1]): r for r in rs}.values()) for b, rs in batches.items()}
    for b, data in batches.items():
        history.merge_batch(shipments(spark, *data), "fact_shipment", path, b)

    def replay(left):
        out = {}
        for b in left:
            out |= {(r[0], r[1]): (r[0], "A", r[1], dt.date.fromisoformat(r[2]), float(r[3]), b) for r in batches[b]}
        return sorted(out.values(), key=repr)

    left = list(batches)
    assert state(spark, path) == replay(left)
    for gone in ([3], [5, 1], [2]):
        left = [b for b in left if b not in gone]
        history.undo_batches(spark, "fact_shipment", path, gone)
        assert state(spark, path) == replay(left)


def test_bulk_load_equals_merges(spark, tmp_path):
    one, two = shipments(spark, ("s1", "L", "2024-01-05", 1), ("s2", None, "2024-01-06", 2)), shipments(spark, ("s2", None, "2024-02-06", 5))
    history.merge_batch(one, "fact_shipment", str(tmp_path / "a"), 1)
    history.merge_batch(two, "fact_shipment", str(tmp_path / "a"), 2)
    from pyspark.sql import functions as F
    both = one.withColumn("load_batch_id", F.lit(1).cast("bigint")).unionByName(two.withColumn("load_batch_id", F.lit(2).cast("bigint")))
    history.load_versions(both, "fact_shipment", str(tmp_path / "b"))
    columns = [*COLUMNS, history.FROM, history.TO, history.OPEN, history.MONTH]
    assert rows(history.versions(spark, str(tmp_path / "a")), *columns) == rows(history.versions(spark, str(tmp_path / "b")), *columns)


def test_rollback_of_ten_facts_rebuilds_the_marts(spark, tmp_path):
    root, log = str(tmp_path / "core"), str(tmp_path / "core/batch_log")
    day = dict(ship_date="2024-01-05", return_date="2024-01-08", order_date="2024-01-02", po_date="2024-01-01", eta_date="2024-01-10", receipt_date="2024-01-11",
               snapshot_date="2024-01-20", effective_from="2024-01-01", invoice_date="2024-01-31")
    text = dict(period="2024-01", currency="KRW", source_system="WMS", charge_type="LAST_MILE_PARCEL", warehouse_id="W", item_id="A", channel_store_id="S", lot_id="L")

    def fact(name, scale):
        kinds = dict(part.strip().split(" ") for part in SCHEMAS[name].split(","))
        row = {c: day.get(c, "2024-06-01") if k == "date" else text.get(c, f"{c}-1") if k == "string" else 1 if k == "bigint" else True if k == "boolean" else 10.0 * scale for c, k in kinds.items()}
        data = frame(spark, name, [row])
        for c, kind in CONTRACTS[name].columns.items():
            if c not in data.columns and c in CONTRACTS[name].key + (CONTRACTS[name].event_date,):
                from pyspark.sql import functions as F
                data = data.withColumn(c, F.lit(day.get(c)).cast("date") if kind == "DATE" else F.lit(text.get(c, c)))
        return data

    for batch, scale in ((1, 1), (2, 3)):
        for name in MEASURES:
            history.merge_batch(fact(name, scale), name, f"{root}/{name}", batch)
        history.log_batch(spark, log, [batch], "success", dt.datetime(2024, 2, batch))
    dims = {"dim_item": frame(spark, "dim_item", [dict(item_id="A", item_type="FG", shelf_life_days=100)]), "period_events": frame(spark, "period_events")}
    steps = ["mart_shipment_daily", "mart_pnl_revenue", "mart_pnl_cogs", "mart_anomaly_signals"]
    gone, run = rollback(spark, root, 1, str(tmp_path / "marts"), None, dims, dt.datetime(2024, 2, 3), steps)
    assert gone == [2] and run.errors == {} and list(run.rows) == steps[:3]
    first = {name: fact(name, 1) for name in MEASURES}
    for name, value in MEASURES.items():
        assert rows(history.current(spark, f"{root}/{name}"), value, "load_batch_id") == [(10.0, 1)]
    fresh = Catalog(spark, first | dims)
    for step in steps[:3]:
        columns = fresh[step].columns
        assert rows(spark.read.parquet(str(tmp_path / "marts" / step)), *columns) == rows(fresh[step], *columns)
    assert rows(history.batch_status(spark, log), "batch_id", "status") == [(1, "success"), (2, "rolled_back")]
    assert rollback(spark, root, 0, str(tmp_path / "marts"))[0] == []


def test_a_merge_writes_its_rows_once_and_beside_the_table(spark, tmp_path, monkeypatch):
    """Rows of the table are joined once and written once; odd months keep their folders apart; nothing is left beside."""
    path, labels = str(tmp_path / "rate"), []
    write = history.materialize
    monkeypatch.setattr(history, "materialize", lambda df, label: labels.append(label) or write(df, label))
    rate = [dict(period=p, currency=c, rate_to_krw=1.0) for p in ("2024/01", "2024-02", None) for c in ("USD", None)]
    history.merge_batch(frame(spark, "fact_exchange_rate", rate), "fact_exchange_rate", path, 1)
    history.merge_batch(frame(spark, "fact_exchange_rate", [r | {"rate_to_krw": 2.0} for r in rate[::2]]), "fact_exchange_rate", path, 2)
    assert labels == ["batch-fact_exchange_rate"]
    merged = [(r["period"], r["currency"], 2.0 if r["currency"] else 1.0) for r in rate]
    assert rows(history.current(spark, path), "period", "currency", "rate_to_krw") == sorted(merged, key=repr)
    assert rows(history.versions(spark, path).filter(~F.col(history.OPEN)), "period", "rate_to_krw", history.TO) == sorted(
        [(r["period"], 1.0, 2) for r in rate[::2]], key=repr)
    history.undo_batches(spark, "fact_exchange_rate", path, [2])
    assert rows(history.current(spark, path), "period", "currency", "rate_to_krw") == sorted([(*list(r.values())[:2], 1.0) for r in rate], key=repr)
    assert {p.name for p in tmp_path.glob("rate/_*")} - {"_open=false"} == {"_SUCCESS", "_open=true"}
    assert not list(tmp_path.glob("rate/_open=false/*")) and not list(tmp_path.glob("rate/.next*"))
