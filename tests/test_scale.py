"""Plans that keep up with larger tables: rows spread over tasks, no broadcast of what grows, one move of the rows."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext

import pytest
from frames import catalog, frame, rows
from pyspark.sql import functions as F

from ledgerloom import Catalog, Policy, session
from ledgerloom.functions.exprs import exact_avg, exact_sum
from ledgerloom.operators import anomaly, expiry, quality, ranking
from ledgerloom.plans import scm
from ledgerloom.sources import canonical, history


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def grid(spark, tmp_path):
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return Catalog(spark, source_dir=str(tmp_path))["fact_inventory_snapshot"]


def test_snapshot_rows_are_those_of_the_formula(grid):
    expected = set()
    for p in range(1, 41):
        for w in range(5):
            for lot in range(3):
                for d in range(20):
                    expiry_date = dt.date(1998, 1, 10) + dt.timedelta((p * 13 + lot * 37) % 500) if p % 4 else None
                    expected.add((dt.date(1998, 1, 1) + dt.timedelta(d), f"W{w}", str(p), f"L{lot}", float(40 + (p * 7 + w * 5 + lot * 11 + d * 3) % 60),
                                  expiry_date, "PENDING" if lot else "Released", p % 17 == 0))
    found = [tuple(r) for r in grid.drop("source_system").collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_snapshot_is_spread_and_its_size_is_known(spark, grid):
    assert grid.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    daily = grid.groupBy("snapshot_date", "warehouse_id", "item_id").agg(F.sum("onhand_qty").alias("q"))
    expected = int(str(daily._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert expected >= daily.count() * 20  # else a join sends it to every task, however many rows there are
    assert "Exchange hashpartitioning(snapshot_date" not in plan(daily)  # grouped where the parts were dealt to


def lots(spark):
    return frame(spark, "fact_inventory_snapshot", [
        dict(snapshot_date=f"2024-01-{d:02d}", warehouse_id=w, item_id=i, lot_id=lot, onhand_qty=1.0,
             expiry_date=None if lot == "C" else f"2024-0{1 + (d + ord(lot)) % 5}-01")
        for d in (1, 2, 3) for w, i in (("W1", "A"), ("W1", "B"), (None, "A")) for lot in "ABC" if i == "A" or d == 1
    ]).withColumnRenamed("expiry_date", "final_expiry_date")


def test_large_keys_are_numbered_in_steps_alike(spark, monkeypatch):
    df, out = lots(spark), ("warehouse_id", "item_id", "snapshot_date", "lot_id", "fefo_rank")
    assert ranking.large_keys(df, expiry.FEFO_KEYS) == (21, None)
    whole = expiry.fefo_rank(df, None)
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 4)
    _, large = ranking.large_keys(df, expiry.FEFO_KEYS)
    assert rows(large, *expiry.FEFO_KEYS) == [("W1", "A")]
    key = str
    assert sorted(rows(expiry.fefo_rank(df, large), *out), key=key) == sorted(rows(whole, *out), key=key)
    assert sorted(r[4] for r in rows(whole, *out) if r[4] and r[:2] == ("W1", "A")) == [1, 2, 3, 4, 5, 6]


def test_pick_list_moves_the_lots_once(spark, monkeypatch):
    monkeypatch.setattr(scm, "RANGE_ROWS", 2)
    cat = catalog(spark, fact_inventory_snapshot=[
        dict(snapshot_date="2024-01-01", warehouse_id="W", item_id=i, lot_id=lot, onhand_qty=1.0, expiry_date=e)
        for i in "BA" for lot, e in (("x", "2024-05-01"), ("y", "2024-02-01"), ("z", None))])
    found = cat["mart_fefo_pick_list"]
    assert plan(found).count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning(warehouse_id" not in plan(found)
    assert [(r.item_id, r.lot_id, r.fefo_rank) for r in found.collect()] == [
        ("A", "y", 1), ("A", "x", 2), ("A", "z", None), ("B", "y", 1), ("B", "x", 2), ("B", "z", None)]


def test_undo_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "FEW", 0)
    keys = session.join_side(spark.range(9).select(F.struct("id").alias("_key")), "keys")
    joined = spark.range(99).select(F.struct("id").alias("_key")).join(keys, "_key", "left_semi")
    assert "SortMergeJoin" in plan(joined) and joined.count() == 9
    path = str(tmp_path / "fact_po")
    first = frame(spark, "fact_po", [dict(po_id=f"P{i}", item_id="A", po_date="2024-01-05", qty_ordered=float(i)) for i in range(4)])
    history.merge_batch(first, "fact_po", path, 1)
    history.merge_batch(first.filter("po_id < 'P2'").withColumn("qty_ordered", F.lit(9.0)), "fact_po", path, 2)
    assert [r[1] for r in rows(history.current(spark, path), "po_id", "qty_ordered")] == [9.0, 9.0, 2.0, 3.0]
    history.undo_batches(spark, "fact_po", path, [2])
    assert [r[1] for r in rows(history.current(spark, path), "po_id", "qty_ordered")] == [0.0, 1.0, 2.0, 3.0]


def test_rules_are_compiled_and_repeated_keys_not_broadcast(spark):
    df = spark.createDataFrame([("f", 1, -1.0, 2.0), ("f", 2, None, -3.0), ("f", 3, 1.0, 1.0), ("f", 4, -1.0, -1.0)], "f string, no int, a double, b double")
    found = quality.flagged(df, ["f", "no"], [("a", F.col("a") < 0), ("b", F.col("b") < 0)])
    assert sorted((r.no, r.problem) for r in found.collect()) == [(1, "a"), (2, "b"), (4, "a"), (4, "b")]
    assert "lambda" not in plan(found)
    twice = quality.repeated_keys(df, "f", "no", ["a"])
    assert [r.no for r in twice.collect()] == [4]
    assert "BroadcastHashJoin" not in plan(twice)


def test_sums_are_counted_in_units_and_exact(spark):
    values = {
        "whole": [3.0, -1.0, None], "parts": [0.1, 0.2, 0.00005, 2.00015, -7.12345], "none": [None],
        "large": [99999999999999.9] * 3000 + [0.0001], "odd": [1e11, 99999999999.99995, -0.0, 12345678901.0625],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    found = df.groupBy("k").agg(exact_sum("v").alias("s"), exact_avg("v").alias("a"))
    # toString of a double, rounded half up to four places, as a cast to decimal does
    expected = {k: [Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP) for v in vs if v is not None] for k, vs in values.items()}
    assert {r.k: r.s for r in found.collect()} == {k: float(sum(vs)) if vs else None for k, vs in expected.items()}
    assert {r.k: r.a for r in found.collect()} == {k: float(sum(vs)) / len(vs) if vs else None for k, vs in expected.items()}
    # Decimals of 28 digits are added as objects, a row at a time.
    assert "partial_sum(cast(v" not in plan(found)


@pytest.mark.parametrize("scale", [1.0, 1e5, 2e9])
def test_detector_in_units_finds_what_decimals_find(spark, scale):
    rng = random.Random(3)
    series = [round(rng.random() * scale, 4) if d % 9 else round(7.7 * scale, 4) for d in range(60)]
    df = spark.createDataFrame([("e", f"2024-{d:03d}", v if d % 13 else None) for d, v in enumerate(series)], "e string, at string, v double")
    expected = []
    for d in range(60):
        seen = [Decimal(repr(v)) for k, v in enumerate(series) if d - 14 < k <= d and k % 13]
        if len(seen) >= 7 and d % 13:
            with localcontext(Context(60)):
                spread = (len(seen) * sum(v * v for v in seen) - sum(seen) ** 2).quantize(Decimal("1e-7"), ROUND_HALF_UP, Context(60))
            mean, n = float(sum(seen)) / len(seen), float(len(seen))
            deviation = (series[d] - mean) / (float(spread) / (n * (n - 1))) ** 0.5
            if abs(deviation) >= 2:
                expected.append((series[d], mean, deviation))
    found = anomaly.detect(df, "at", "v", ["e"], "m", "t", Policy())
    assert expected and rows(found, "current_value", "expected_value", "deviation") == sorted(expected, key=repr)
    assert "sum(_few" in plan(found)


@pytest.mark.parametrize("lots_in_row", [1_000, 1])
def test_many_lots_are_met_by_item_without_moving_the_snapshot(spark, tmp_path, monkeypatch, lots_in_row):
    def made(items, lots):
        return spark.createDataFrame([(i, lot, dt.date(1997, 1, 1 + k)) for k, lot in enumerate(lots) for i in items], "item_id string, lot_id string, _mfg date")

    spark.range(1, 13).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    cat = Catalog(spark, source_dir=str(tmp_path))
    snapshot, dates = cat["fact_inventory_snapshot"], made(["1", "2"], ["L0", "L2"]).unionByName(made(["3", "x"], ["L1"]))
    items = cat["dim_item"].unionByName(cat["dim_item"].filter("item_id = '2'"))  # a key may repeat
    snapshot = snapshot.unionByName(snapshot.limit(3).withColumn("lot_id", F.lit(None).cast("string"))) if lots_in_row == 1 else snapshot
    names = ["item_id", "lot_id", "snapshot_date", "warehouse_id", "item_type", "_mfg"]
    whole = rows(expiry.with_made(snapshot, items, dates), *names)
    monkeypatch.setattr(session, "FEW", 0)
    monkeypatch.setattr(expiry, "LOTS_IN_ROW", lots_in_row)
    spread = expiry.with_made(snapshot, items, dates)
    assert rows(spread, *names) == whole
    if lots_in_row > 1:
        assert "ShuffledHashJoin [item_id" in plan(spread) and "Sort [item_id#" not in plan(spread).split("BroadcastNestedLoopJoin")[0]


@pytest.mark.parametrize("name", ["mart_anomaly_signals", "kpi_forecast"])
def test_line_items_are_ranked_once_for_several_facts(spark, tmp_path, name):
    spark.range(1, 9).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    day = F.expr("timestamp '1998-01-01' + make_interval(0, 0, 0, int(id % 40))")
    lines = spark.range(80).select(
        (F.col("id") % 20).alias("l_orderkey"), (F.col("id") % 8 + 1).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"),
        (F.col("id") % 5).cast("int").alias("l_linenumber"), *[F.lit(v).alias(c) for c, v in (
            ("l_quantity", 5.0), ("l_extendedprice", 100.0), ("l_discount", 0.0), ("l_tax", 0.0))], F.lit("R").alias("l_returnflag"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"), day.alias("l_shipdate"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = Catalog(spark, source_dir=str(tmp_path))[name]
    assert "Window [row_number() windowspecdefinition(l_orderkey" not in plan(found)
    assert found.count() == 1 or name == "mart_anomaly_signals"


def test_line_items_are_dealt_out_before_they_are_ordered(spark, tmp_path, monkeypatch):
    """A task orders a bounded number of lines, however long the piece of the file that was read at once."""
    lines = spark.range(90).select(
        (F.col("id") % 40).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.expr("date_add(DATE'1995-01-01', CAST(id AS int))").alias("l_shipdate"),
        *(F.col("id").alias(f"l_{c}") for c in ("partkey", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus")))
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(canonical, "LINE_ROWS", 9)
    li = Catalog(spark, source_dir=str(tmp_path))["li"]
    assert sorted((r.l_orderkey, r.l_partkey) for r in li.collect()) == sorted((k % 40, k) for k in range(50, 90))
    first = next(step for step in reversed(plan(li).split("\n")) if "Sort" in step or "Exchange" in step)
    assert "hashpartitioning(l_orderkey" in first and ", 10), REPARTITION_BY_NUM" in first
