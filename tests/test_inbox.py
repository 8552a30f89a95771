"""The inbox stream: its ledger, its rule set, and batches that are run again."""

import pytest
from frames import rows
from test_ingest import HEADERS, order_file

from ledgerloom.sources import history
from ledgerloom.sources.tables import drop_path
from ledgerloom.streaming.inbox import inbox_stream, once


class Stopped(Exception):
    pass


def test_ledger_skips_done_batches_and_keeps_ids_of_started_ones(spark, tmp_path):
    path, seen = str(tmp_path / "ledger"), []
    assert once(spark, path, "q", 0, seen.append) and not once(spark, path, "q", 0, seen.append)
    assert once(spark, path, "other", 0, seen.append)

    def fails(batch):
        seen.append(batch)
        raise Stopped

    with pytest.raises(Stopped):
        once(spark, path, "q", 1, fails)
    assert once(spark, path, "q", 1, seen.append)
    assert seen == [1, 2, 3, 3]
    assert rows(spark.read.parquet(path), "query_id", "stream_batch", "load_batch_id", "status")[-1] == ("q", 1, 3, "started")


def charge_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    head = "source_system,invoice_no,invoice_line_no,charge_type,amount,currency,period,invoice_date"
    (folder / name).write_text("\n".join([head, *lines]) + "\n")
    return head.split(",")


def test_whole_rule_set_by_file(spark, tmp_path):
    inbox, path, log = tmp_path / "in", str(tmp_path / "core"), str(tmp_path / "log")
    heads = charge_file(inbox, "ok.csv", ["ERP,I1,1,LAST_MILE_PARCEL,10,KRW,2024-01,2024-01-31", "ERP,I1,2,LAST_MILE_PARCEL,999999999999,KRW,2024-04,2024-04-30"])
    charge_file(inbox, "unknown.csv", ["ERP,I2,1,MYSTERY,10,KRW,2024-01,2024-01-31"])
    charge_file(inbox, "twice.csv", ["ERP,I3,1,LAST_MILE_PARCEL,10,KRW,2024-01,2024-01-31", "ERP,I3,1,LAST_MILE_PARCEL,11,KRW,2024-01,2024-01-31"])
    inbox_stream(spark, str(inbox), heads, "fact_charge_actual", path, log).awaitTermination()
    assert rows(spark.read.parquet(path), "invoice_no", "invoice_line_no") == [("I1", 1), ("I1", 2)]
    failed = spark.read.parquet(f"{log}_dq").filter("NOT passed")
    got = {(r.file_path.rsplit("/", 1)[1], r.check_name, r.bad_rows) for r in failed.collect() if not r.check_name.startswith("date_range")}
    assert got == {("ok.csv", "amount_outlier_amount", 1), ("ok.csv", "period_continuity", 2), ("unknown.csv", "charge_type_validation", 1),
                   ("twice.csv", "duplicate_business_keys", 1)}


def test_missing_source_system_rejects(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("period,currency,rate_to_krw\n2024-01,USD,1300\n")
    inbox_stream(spark, str(inbox), ["period", "currency"], "fact_exchange_rate", str(tmp_path / "core"), str(tmp_path / "log")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "log")), "status") == [("dq_failed",)]


def test_offending_rows_are_named(spark, tmp_path):
    inbox, log = tmp_path / "in", str(tmp_path / "log")
    order_file(inbox, "bad.csv", [f"OMS,O{i},1,2024-01-15,A,SKU,{-1 if i % 3 == 0 else 5}" for i in range(1, 31)])
    inbox_stream(spark, str(inbox), HEADERS, "fact_order", str(tmp_path / "core"), log).awaitTermination()
    [r] = spark.read.parquet(f"{log}_dq").filter("check_name = 'quantity_range_qty_ordered'").collect()
    assert (r.bad_rows, r.sample, r.passed) == (10, "3, 6, 9, 12, 15", False)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    inbox, path, log = tmp_path / "in", str(tmp_path / "core"), str(tmp_path / "log")

    def run():
        inbox_stream(spark, str(inbox), HEADERS, "fact_order", path, log, versioned=True).awaitTermination()
        return rows(history.current(spark, path), "channel_order_id", "qty_ordered", "load_batch_id")

    order_file(inbox, "a.csv", ["OMS,O1,1,2024-01-15,A,SKU,10"])
    run()
    order_file(inbox, "b.csv", ["OMS,O1,1,2024-01-15,A,SKU,12", "OMS,O2,1,2024-01-16,A,SKU,1"])
    order_file(inbox, "copy_of_b.csv", ["OMS,O1,1,2024-01-15,A,SKU,12", "OMS,O2,1,2024-01-16,A,SKU,1"])
    state = run()
    assert state == [("O1", 12.0, 2), ("O2", 1.0, 2)]
    drop_path(spark, f"{log}_checkpoint/commits/1")
    assert run() == state
    logged = rows(spark.read.parquet(log), "row_count", "status")
    assert logged == [(0, "skipped"), (1, "success"), (2, "success")]
    # A batch that stopped after its merge, before it was entered as done.
    ledger = spark.read.parquet(f"{log}_ledger").filter("NOT (stream_batch = 1 AND status = 'done')").collect()
    spark.createDataFrame(ledger).write.parquet(str(tmp_path / "cut"))
    drop_path(spark, f"{log}_ledger")
    spark.read.parquet(str(tmp_path / "cut")).write.parquet(f"{log}_ledger")
    drop_path(spark, f"{log}_checkpoint/commits/1")
    assert run() == state and history.versions(spark, path).count() == 3
    assert len({r.query_id for r in spark.read.parquet(f"{log}_ledger").collect()}) == 1
