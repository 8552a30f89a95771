"""Files, checks, merges and the inbox stream."""

import datetime as dt

import pytest
from frames import catalog, rows
from pyspark.sql import functions as F

from ledgerloom import Policy
from ledgerloom.operators import ingest, quality
from ledgerloom.sources import files, uploadlog
from ledgerloom.sources.contracts import CONTRACTS
from ledgerloom.sources.tables import conform, merge_into, write_mart
from ledgerloom.streaming.inbox import inbox_stream

HEADERS = ["system", "주문번호", "라인", "주문일", "스토어ID", "상품코드", "주문수량"]


def order_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(HEADERS), *lines]) + "\n", encoding="utf-8")


def test_headers_map_and_table_is_detected(spark, tmp_path):
    order_file(tmp_path / "in", "a.csv", ["OMS,ORD-1,1,2024-01-15,A,SKU,10"])
    scanned = files.inbox_scan(spark, str(tmp_path / "in"))
    [found] = files.detect_table(scanned).collect()
    assert (found.table_name, found.score) == ("fact_order", 1.0)
    raw = files.read_csv_strings(spark, str(tmp_path / "in"))
    out = ingest.cast_columns(ingest.filter_columns(ingest.apply_aliases(raw, "fact_order"), "fact_order"), "fact_order")
    assert rows(out, "channel_order_id", "line_no", "order_date", "qty_ordered") == [
        ("ORD-1", 1, dt.date(2024, 1, 15), 10.0)]


def test_unknown_header_and_tie_fail(spark):
    heads = spark.createDataFrame([("x", "alpha,beta"), ("y", "item_id")], "file_path string, header string")
    assert {r.file_path: r.table_name for r in files.detect_table(heads).collect()} == {"x": None, "y": None}


def test_override_alias_wins(spark):
    df = spark.createDataFrame([("1",)], "`코드` string")
    assert ingest.apply_aliases(df, "fact_order", [(None, "코드", "item_id")]).columns == ["item_id"]


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1\n1,2,3\n")
    assert rows(files.read_csv_strings(spark, str(tmp_path / "r.csv"))) == [("1", "2"), ("1", None)]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("x", "2024/01/05", "YES"), ("7", "soon", "maybe")], "onhand_qty string, expiry_date string, hold_flag string")
    assert rows(ingest.cast_columns(df, "fact_inventory_snapshot")) == [
        (7.0, None, None), (None, dt.date(2024, 1, 5), True)]


def test_sentinel_for_absent_and_null_lot(spark):
    df = spark.createDataFrame([("S", "I", None)], "shipment_id string, item_id string, lot_id string")
    for frame in (df, df.drop("lot_id")):
        out = ingest.add_system_columns(frame, "fact_shipment", 1, F.lit("h"), dt.date(2024, 1, 1))
        assert [r.lot_id for r in out.collect()] == ["__NONE__"]


def staged(spark, data):
    return spark.createDataFrame(data, "channel_order_id string, line_no bigint, order_date date, qty_ordered double")


def test_merge_is_idempotent_and_follows_a_moved_row(spark, tmp_path):
    path = str(tmp_path / "fact_order")
    jan, feb = dt.date(2024, 1, 5), dt.date(2024, 2, 5)
    first = staged(spark, [("O1", 1, jan, 1.0), ("O2", 1, feb, 2.0)])
    merge_into(first, "fact_order", path)
    again = merge_into(first, "fact_order", path)
    assert again.count() == 2
    moved = merge_into(staged(spark, [("O1", 1, feb, 9.0)]), "fact_order", path)
    assert rows(moved, "channel_order_id", "order_date", "qty_ordered") == [("O1", feb, 9.0), ("O2", feb, 2.0)]
    assert not (tmp_path / "fact_order" / "_month=2024-01").exists()


def test_write_mart_refreshes_and_checks_schema(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("2024-01", 1)], "period string, n int")
    write_mart(df, path, "period")
    assert write_mart(df.filter("false"), path).count() == 0
    with pytest.raises(TypeError):
        conform(df, staged(spark, []).schema)


def test_gate_rejects_on_hard_failures_only(spark):
    df = spark.createDataFrame(
        [("OMS", "S1", "2024-01-01", "W", "I", "-5", "L"), ("OMS", "S1", "2024-01-01", "W", "I", "x", "L")],
        "source_system string, shipment_id string, ship_date string, warehouse_id string, item_id string, "
        "qty_shipped string, lot_id string")
    report = quality.run_all(df, "fact_shipment", Policy(as_of=dt.date(2024, 2, 1)))
    failed = {r.check_name: r.bad_rows for r in report.filter("NOT passed").collect()}
    assert failed == {"duplicate_business_keys": 1, "type_coercion_qty_shipped": 1, "quantity_range_qty_shipped": 1}
    old = quality.run_all(df.filter("qty_shipped = '-5'").withColumn("qty_shipped", F.lit("5")), "fact_shipment",
                          Policy(as_of=dt.date(2044, 2, 1))).withColumn("file_name", F.lit("f"))
    [verdict] = quality.gate(old, ["file_name"]).collect()
    assert (verdict.failures, verdict.warnings, verdict.rejected) == (0, 1, False)


def test_missing_required_column(spark):
    df = spark.createDataFrame([("2024-01", "USD")], "period string, currency string")
    [row] = quality.required_columns(df, "fact_exchange_rate").collect()
    assert (row.passed, row.bad_rows) == (False, 1)


def test_period_gap(spark):
    df = spark.createDataFrame([("2023-11",), ("2024-02",), (None,)], "period string")
    assert rows(quality.missing_months(df)) == [("2023-12",), ("2024-01",)]


def test_content_hash_ignores_order_and_names(spark):
    a = [("f1", 1, "x", 1.0), ("f1", 2, "y", 2.0)]
    b = [("f2", 9, "y", 2.0), ("f2", 8, "x", 1.0)]
    c = [("f3", 1, "x", 1.0), ("f3", 2, "y", 2.5)]
    df = spark.createDataFrame(a + b + c, "file string, no int, item string, qty double")
    hashes = ingest.content_hash(df, ["file"], ["no"])
    marked = ingest.mark_duplicates(hashes, ["file"])
    assert rows(marked, "file", "status") == [("f1", "success"), ("f2", "duplicate"), ("f3", "success")]


def test_promotion_datasets_cover_contracts():
    for promotion in ingest.PROMOTIONS.values():
        assert set(promotion["key"]) == set(CONTRACTS[promotion["core"]].key)
        assert set(promotion["columns"]) <= set(CONTRACTS[promotion["core"]].columns)


def test_inbox_stream_loads_gates_and_resumes(spark, tmp_path):
    inbox, path, log = tmp_path / "in", str(tmp_path / "core"), str(tmp_path / "log")
    closed = spark.createDataFrame([("2023-12",)], "period string")

    def run():
        inbox_stream(spark, str(inbox), HEADERS, "fact_order", path, log, closed=closed,
                     checkpoint=str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(path)

    order_file(inbox, "a.csv", ["OMS,O1,1,2024-01-15,A,SKU,10", "OMS,O2,1,2023-12-15,A,SKU,1"])
    order_file(inbox, "bad.csv", ["OMS,O9,1,2024-01-15,A,SKU,-4"])
    assert rows(run(), "channel_order_id", "qty_ordered") == [("O1", 10.0)]
    assert rows(spark.read.parquet(log), "row_count", "status") == [(1, "dq_failed"), (2, "success")]
    order_file(inbox, "c.csv", ["OMS,O1,1,2024-01-15,A,SKU,12", "OMS,O3,1,2024-02-15,A,SKU,3"])
    assert rows(run(), "channel_order_id", "qty_ordered") == [("O1", 12.0), ("O3", 3.0)]


def test_pipeline_writes_every_mart(spark, tmp_path):
    from ledgerloom import Catalog
    from ledgerloom.plans.pipeline import run_pipeline

    cat = Catalog(spark, source_dir="/root/testdata/sf0.001")
    steps = ["mart_shipment_daily", "mart_pnl_revenue", "mart_pnl_cogs", "mart_pnl_gross_margin"]
    run = run_pipeline(cat, str(tmp_path), steps)
    assert run.errors == {} and all(run.rows[s] > 0 for s in steps)
    dry = run_pipeline(catalog(spark), str(tmp_path / "dry"), steps, dry_run=True)
    assert set(dry.rows) == set(steps) and not (tmp_path / "dry").exists()


def test_upload_log_knows_content_by_table(spark, tmp_path):
    path = str(tmp_path / "log")

    def sent(batch, names, table="upload_shipment", force=False, value="x"):
        data = spark.createDataFrame([(n, value, 1.0) for n in names], "source_file_name string, item string, qty double")
        hashes = ingest.content_hash(data, ["source_file_name"], [], table).withColumn("table_name", F.lit(table))
        return rows(uploadlog.admit(hashes, path, batch, force), "source_file_name", "status", "first_batch")

    first = [("a", "success", None), ("b", "duplicate", 1)]
    assert sent(1, ["a", "b"]) == first
    assert sent(1, ["a", "b"]) == first  # run again, it does not find itself
    assert sent(2, ["c"]) == [("c", "duplicate", 1)]
    assert sent(3, ["c"], force=True) == [("c", "success", None)]
    assert sent(4, ["c"], table="upload_return") == [("c", "success", None)]
    assert sent(5, ["a"], value="y") == [("a", "success", None)]
    assert uploadlog.read_log(spark, path).count() == 6
