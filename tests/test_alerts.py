"""Alert suppression against a sequential reading of the rule, and pivots without a value list."""

import datetime as dt
import random

import pytest
from frames import frame, rows
from pyspark.sql import functions as F

from ledgerloom.operators.alerts import suppress
from ledgerloom.plans.dashboards import revenue_trend
from ledgerloom.plans.planning import report

START = dt.datetime(2024, 1, 1)


def sequential(data, hours):
    kept = {}
    for s, t, i in sorted((r for r in data if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        mine = kept.setdefault(s, [])
        if not mine or t >= mine[-1][0] + dt.timedelta(hours=hours):
            mine.append([t, i, 0])
        mine[-1][2] += 1
    return sorted(((s, i, t, n) for s, found in kept.items() for t, i, n in found), key=repr)


@pytest.mark.parametrize("hours,seed", [(24, 1), (24, 2), (6, 3)])
def test_equal_to_a_sequential_pass(spark, hours, seed):
    pick = random.Random(seed)
    spread = {"hot": 60 * 8, "rare": 60 * 24 * 20, None: 60 * 24 * 3}
    data, i = [], 0
    for s, minutes in spread.items():
        for _ in range(150):
            # Whole hours often, so that alerts stand exactly a window apart.
            step = pick.randrange(minutes)
            data.append((s, START + dt.timedelta(minutes=step * 4 // 60 * 60 if pick.random() < 0.6 else step * 4), i))
            i += 1
    data += [("hot", START, 9000), ("hot", START, 8000), ("rare", None, 9001), ("edge", START, 1), ("edge", START + dt.timedelta(hours=hours), 2),
             ("edge", START + dt.timedelta(hours=2 * hours, microseconds=-1), 3)]
    df = spark.createDataFrame(data, "who string, at timestamp, id long").repartition(5).withColumn("signals", F.lit("x"))
    assert rows(suppress(df, ["who"], "at", "id", hours * 3600)) == sequential(data, hours)


def test_whole_days_and_no_alerts(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), d) for d in (1, 2, 2, 5)], "who string, at date, id long")
    assert rows(suppress(df, ["who"], "at", "id")) == [("a", 1, dt.date(2024, 1, 1), 1), ("a", 2, dt.date(2024, 1, 2), 2), ("a", 5, dt.date(2024, 1, 5), 1)]
    assert suppress(df.filter("false"), ["who"], "at", "id").collect() == []


def test_unlisted_channels_and_unknown_appear(spark):
    df = spark.createDataFrame([("2024-01", "S1", 1.5), ("2024-01", "BRAND NEW", 2.0), ("2024-01", None, 3.0), ("2024-01", "S1", 1.0), ("2024-02", "S1", None)],
                               "period string, channel_store_id string, net_revenue_krw double")
    [row] = revenue_trend(df).collect()
    assert [tuple(x) for x in row.by_channel] == [("BRAND NEW", 2.0), ("S1", 2.5), ("UNKNOWN", 3.0)] and row.net_revenue_krw == 7.5


def test_report_pivots_over_whatever_is_there(spark):
    ships = frame(spark, "fact_shipment", [dict(warehouse_id=w, item_id="A", qty_shipped=q) for w, q in (("W9", 1.0), ("X", 2.0), (None, 4.0), ("W9", 3.0))])
    [row] = report(ships, ["item_id"], {"qty": ("qty_shipped", "sum")}, "warehouse_id").collect()
    assert [tuple(x) for x in row.by_warehouse_id] == [(None, 4.0), ("W9", 4.0), ("X", 2.0)]
    assert report(ships, ["item_id"], {"qty": ("qty_shipped", "sum")}).columns == ["item_id", "qty"]
