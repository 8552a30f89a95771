"""Upload checks, file reports and stock spans: rows made once, moved as little as the job allows."""

from frames import catalog, frame, rows
from pyspark.sql import functions as F

from ledgerloom import Catalog
from ledgerloom.operators import allocation, quality
from ledgerloom.plans.quality import _digits
from ledgerloom.policy import Policy
from ledgerloom.sources import canonical, uploads


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_two_rows_need_no_join(spark):
    schema = "f string, no int, day date, k string"
    two = spark.createDataFrame([("f", 1, None, ""), ("f", 4, None, None), ("f", 2, None, "__NONE__x"), ("g", 9, None, ""),
                                 (None, 1, None, "a"), (None, 2, None, "a"), ("f", None, None, "b"), ("f", 3, None, "b"), ("f", 8, None, "b")], schema)
    found = quality.repeated_keys(two, "f", "no", ["day", "k"])
    assert rows(found, "f", "no") == [("f", 4), ("f", 8)]
    assert "Join" not in plan(found)
    more = two.unionByName(two.filter("no = 4")).unionByName(two.filter("no = 4").withColumn("no", F.lit(7)))
    assert rows(quality.repeated_keys(more, "f", "no", ["day", "k"]), "f", "no") == [("f", 4), ("f", 4), ("f", 7), ("f", 8)]


def test_upload_rows_are_made_once_and_corrected(spark):
    cat = catalog(spark, fact_po=[dict(po_id=f"P{i}" if i else None, item_id="A", po_date="2024-01-05", qty_ordered=float(i)) for i in range(60)])
    sent = uploads.dataset_upload(cat, "purchase_order")
    assert "Union" not in plan(sent)
    digit = {r[0]: r[1] for r in cat["fact_po"].select("po_id", F.substring(F.md5("po_id"), 1, 1)).collect()}
    expected = [(f"P{i}" if i else None, 1, float(i)) for i in range(60)] + [
        (f"P{i}", 2, -1.0 if digit[f"P{i}"] == "0" else i + 1000.0) for i in range(1, 60) if digit[f"P{i}"] < "5"]
    assert rows(sent, "po_id", "batch_id", "qty_ordered") == sorted(expected, key=repr)


def test_lines_are_written_once(spark, tmp_path):
    spark.sql("SELECT 1L l_orderkey, 1 l_linenumber, 2L l_partkey, 3L l_suppkey, 4D l_quantity, 5D l_extendedprice, 0D l_discount, 0D l_tax, "
              "'R' l_returnflag, 'F' l_linestatus, DATE'1995-01-01' l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    cat = Catalog(spark, source_dir=str(tmp_path))
    canonical.share_lines(cat)
    assert "Window" not in plan(cat["fact_return"]) and cat["fact_return"].count() == 1
    given = catalog(spark)
    canonical.share_lines(given)  # nothing to derive: the tables were given


def test_dates_of_a_file_are_read_once_a_row(spark):
    text = frame(spark, "fact_po", [dict(po_id=p, item_id="A", qty_ordered=1.0) for p in "ab"]).withColumns(
        {"po_date": F.when(F.col("po_id") == "a", "1950/01/01").otherwise("soon"), "eta_date": F.lit("2999.01.01"), "f": F.lit("x")})
    found = quality.report_by_file(text, "fact_po", Policy(), "f")
    bad = {r.check_name: r.bad_rows for r in found.collect()}
    assert (bad["date_range_past_po_date"], bad["date_range_future_po_date"], bad["date_range_future_eta_date"]) == (1, 0, 2)
    assert plan(found).count("yyyy/MM/dd") == 1  # po_date, once; eta_date is folded, being constant


def test_digits_of_a_text(spark):
    df = spark.createDataFrame([("W12",), ("SH7-3",), ("007",), ("-5 \u00e91\U0001f600",), (None,)], "t string")
    assert [r[0] for r in df.select(_digits("t")).collect()] == [12, 73, 7, 51, None]
    assert "regexp" not in plan(df.select(_digits("t")))


def test_stock_spans_go_to_the_rows(spark):
    stock = frame(spark, "fact_inventory_snapshot", [
        dict(snapshot_date=d, warehouse_id=w, item_id="A", lot_id="L", onhand_qty=2.0)
        for w in ("W1", None) for d in ("2024-01-30", "2024-02-02")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # sizes are no reason to send anything
    try:
        days = allocation.stock_days(stock)
        assert "BroadcastHashJoin" in days._jdf.queryExecution().executedPlan().toString()
        assert rows(days) == sorted([(m, w, "A", "L", q) for w in ("W1", None) for m, q in (("2024-01", 4.0), ("2024-02", 2.0 + 56.0))], key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
