"""Keys and file checks over rows that are dealt out already: nothing is moved, results are those of a plain loop."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frames import catalog, rows
from ledgerloom import Catalog, Policy, session
from ledgerloom.operators import ingest, quality
from ledgerloom.plans import constraint
from ledgerloom.plans import quality as quality_plans
from ledgerloom.plans.quality import _file


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def later_rows(data):
    """(file, row) of all rows after the first of their key; a missing part is one value however it is missing."""
    groups = defaultdict(list)
    for f, no, day, a, b in data:
        if f is not None and no is not None:
            groups[f, day, *(x or "__NONE__" for x in (a, b))].append(no)
    return sorted(((k[0], n) for k, found in groups.items() for n in found if n > min(found)), key=repr)


@pytest.mark.parametrize("limits", [(1000, 200_000), (4, 200_000), (4, 0)])
@pytest.mark.parametrize("missing", [[None], [""], [None, "", "__NONE__"]])
def test_later_rows_of_keys_of_any_length(spark, monkeypatch, limits, missing):
    monkeypatch.setattr(quality, "ROWS_OF_KEY", limits[0])
    monkeypatch.setattr(quality, "FEW", limits[1])
    rng = random.Random(len(missing) + limits[0])
    data = [(rng.choice(["f", "g", None]), rng.choice([None, *range(40)]), rng.choice([None, 1]), rng.choice(["x", "y", *missing]), rng.choice(["u", *missing]))
            for _ in range(120)]
    df = spark.createDataFrame(data, "f string, no bigint, day int, a string, b string")
    assert rows(quality.repeated_keys(df, "f", "no", ["day", "a", "b"]), "f", "no") == later_rows(data)


def test_keys_dealt_out_by_a_part_are_not_moved(spark):
    df = spark.range(300).select(
        F.lit("f").alias("f"), F.col("id").alias("no"), (F.col("id") % 50).cast("string").alias("a"), F.when(F.col("id") % 7 > 0, "u").alias("b"))
    found = quality.repeated_keys(df.repartition(3, "a"), "f", "no", ["a", "b"])
    # Keys with more than two rows are listed where they lie; only the dealing itself is an exchange.
    assert "Exchange hashpartitioning(f" not in physical(found) and "Exchange hashpartitioning(a" in physical(found)
    data = [(r.f, r.no, None, r.a, r.b) for r in df.collect()]
    assert rows(found, "f", "no") == later_rows(data)


def test_days_are_read_as_the_patterns_do(spark):
    rng = random.Random(4)
    texts = ["2024-02-29", "2023-02-29", "2024/01/05", "2024.01.05", "0000-01-01", "0001-01-01", "9999-12-31", "10000-1-01", "+024-01-01", "-024-01-01",
             "2024-01-1 ", "2024-01-1T", "2024-01- 1", " 2024-1-01", "2024-1-01 ", "2024--1-01", "2024-01-0١", "2024-1-1", "20240101", "", None, "soon"]
    texts += ["".join(rng.choice("0123456789") if c == "0" and rng.random() < 0.95 else rng.choice("-/.0 T+é") if rng.random() < 0.05 else c for c in "2000-00-00") for _ in range(2000)]
    patterns = F.coalesce(*[F.try_to_date("t", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", ingest.to_date(F.col("t")).cast("string").alias("a"), patterns.cast("string").alias("b")).collect()
    assert [r.t for r in found if r.a != r.b] == [] and sum(r.a is not None for r in found) > 50


def test_file_of_dealt_rows_is_counted_where_it_lies(spark, tmp_path):
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    cat = Catalog(spark, source_dir=str(tmp_path))
    made = _file(cat, "fact_inventory_snapshot")
    sign = F.when(F.substring(F.md5(F.col("snapshot_date").cast("string")), 1, 1) == "0", -1).otherwise(1)
    plain = cat["fact_inventory_snapshot"].withColumn("onhand_qty", F.col("onhand_qty") * sign)
    plain = plain.select(*[F.col(c).cast("string").alias(c) for c in plain.columns])
    assert made.columns == plain.columns and made.exceptAll(plain).isEmpty() and made.count() == plain.count()
    report = quality.report_by_file(made.withColumn("f", F.lit("x")), "fact_inventory_snapshot", Policy(), "f")
    assert not re.search(r"Exchange hashpartitioning\([^)]*warehouse_id", physical(report))
    assert {r.check_name: r.bad_rows for r in report.collect()}["duplicate_business_keys"] == 0


def test_file_of_a_missing_day_keeps_its_rows(spark):
    stock = [dict(snapshot_date=d, item_id=i, onhand_qty=2.0) for d in ("2024-01-05", None) for i in "AB"]
    made = _file(catalog(spark, fact_inventory_snapshot=stock), "fact_inventory_snapshot")
    assert [(r[0], r[1]) for r in rows(made, "snapshot_date", "item_id")] == [("2024-01-05", "A"), ("2024-01-05", "B"), (None, "A"), (None, "B")]


def test_files_are_not_written_as_text_to_be_counted(spark, tmp_path, monkeypatch):
    labels = []
    write = session.materialize
    monkeypatch.setattr(quality_plans, "materialize", lambda df, label: labels.append(label) or write(df, label))
    report = catalog(spark, fact_po=[dict(po_id="P", item_id="A", po_date="2024-01-05", qty_ordered=1.0)], fact_shipment=[
        dict(shipment_id="S", item_id="1", ship_date="2024-01-05", warehouse_id="W", qty_shipped=1.0)])["dq_report"]
    assert report.filter("file_name = 'purchases.csv'").count() > 0
    assert "file-fact_inventory_snapshot" not in labels and "dq-report" in labels


def test_signals_are_written_once_and_a_kind_at_a_time(spark):
    late = [dict(po_id=f"P{i}", po_date=f"2000-0{1 + i % 4}-05", supplier_id="S", item_id="A", qty_ordered=1.0, eta_date="2000-01-06") for i in range(8)]
    cat = catalog(spark, fact_po=late)
    found = cat["mart_constraint_effectiveness"]
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in logical and "Aggregate" not in cat["mart_constraint_signals"]._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "metric_name", "before_value", "after_value", "delta", "period") == [
        ("late_po_ratio", 1.0, 0.0, -1.0, p) for p in ("2000-02", "2000-04")]
    given = catalog(spark, fact_po=late)
    given["mart_constraint_signals"] = cat["mart_constraint_signals"]
    constraint.share_signals(given)
    assert given["mart_constraint_signals"] is cat["mart_constraint_signals"]  # what was there stays
