"""Read-side queries: filters, time buckets, headline figures, splits and trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import Catalog, query
from ledgerloom.functions.exprs import (
    MONEY, by_value, exact_avg, exact_sum, literal_table, month, rate_avg, ratio, side_by_side, sum0,
    weighted_avg,
)
from ledgerloom.session import scratch_dir
from ledgerloom.sources.tables import read_months, write_monthly

# ---- filters ------------------------------------------------------------
# mart: the date column a range applies to; marts not listed filter by period
DATE_COLUMNS = {
    "mart_inventory_onhand": "snapshot_date", "mart_stockout_risk": "as_of_date", "mart_shipment_daily": "ship_date",
    "mart_return_daily": "return_date",
}


def periods_between(start: dt.date, end: dt.date) -> list[str]:
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def apply_filters(
    df: DataFrame, mart: str, start: dt.date | None = None, end: dt.date | None = None, **equals: str | None,
) -> DataFrame:
    """Date range (by day or by month, as the mart allows) and equality filters."""
    if start and end:
        day = DATE_COLUMNS.get(mart)
        if day:
            df = df.filter((F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end + dt.timedelta(days=1))))
        elif "period" in df.columns:
            df = df.filter(F.col("period").isin(periods_between(start, end)))
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def publish(cat: Catalog, mart: str, path: str | None = None) -> tuple[str, T.StructType]:
    """Write a mart by month, once a catalog; its path and schema."""
    places = cat.notes.setdefault("published", {})
    if mart not in places:
        df, day = cat[mart], DATE_COLUMNS.get(mart)
        path = path or scratch_dir(cat.spark, mart)
        places[mart] = path, write_monthly(df, path, month(day) if day else F.col("period"))
    return places[mart]


def read_published(
    cat: Catalog, mart: str, start: dt.date | None = None, end: dt.date | None = None, **equals: str | None,
) -> DataFrame:
    """A published mart under the filters; only the folders of the months asked for are read."""
    months = periods_between(start, end) if start and end else None
    return apply_filters(read_months(cat.spark, *publish(cat, mart), months), mart, start, end, **equals)


SPRING = (dt.date(1998, 1, 15), dt.date(1998, 4, 20))


@query("scm_filter")
def scm_filter(cat: Catalog) -> DataFrame:
    return read_published(cat, "mart_shipment_daily", *SPRING, warehouse_id="W1")


@query("scm_filter_periods")
def scm_filter_periods(cat: Catalog) -> DataFrame:
    return read_published(cat, "mart_open_po", *SPRING, supplier_id="7")


@query("pnl_filter")
def pnl_filter(cat: Catalog) -> DataFrame:
    return read_published(cat, "mart_pnl_revenue", *SPRING, channel_store_id="S3", country="KR")


# ---- time ---------------------------------------------------------------
def bucket(day: Column, grain: str) -> Column:
    """Day, week of the year (weeks start on Sunday, week 1 holds January 1), month or year."""
    if grain == "day":
        return day.cast("string")
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    if grain == "year":
        return F.date_format(day, "yyyy")
    offset = F.dayofweek(F.trunc(day, "year")) - 1
    week = F.floor((F.dayofyear(day) - 1 + offset) / 7) + 1
    return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def advised_grain(days: Column) -> Column:
    return F.when(days <= 31, "day").when(days <= 120, "week").when(days <= 730, "month").otherwise("year")


@query("time_bucket")
def time_bucket(cat: Catalog) -> DataFrame:
    day = F.col("order_date")
    return cat["fact_order"].groupBy("order_date").agg(F.count(F.lit(1)).alias("lines")).select(
        *[bucket(day, g).alias(g) for g in ("day", "week", "month", "year")], "lines")


@query("time_grain")
def time_grain(cat: Catalog) -> DataFrame:
    """The grain a chart of each item's orders should use."""
    days = F.datediff(F.max("order_date"), F.min("order_date")) + 1
    return cat["fact_order"].groupBy("item_id").agg(days.alias("days"), advised_grain(days).alias("grain"))


# ---- coverage -----------------------------------------------------------
def coverage_of(df: DataFrame) -> DataFrame:
    """Row count and NO_DATA, ACTUAL or PARTIAL over a result."""
    flag = F.col("coverage_flag") if "coverage_flag" in df.columns else F.lit(None).cast("string")
    whole = F.coalesce(F.bool_and(F.when(flag.isNotNull(), flag == "ACTUAL")), F.lit(True))
    state = F.when(F.count(F.lit(1)) == 0, "NO_DATA").when(whole, "ACTUAL").otherwise("PARTIAL")
    return df.agg(F.count(F.lit(1)).alias("row_count"), state.alias("coverage_flag"))


def _coverage_rows(cat: Catalog, inputs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in inputs.items():
        one = coverage_of(df).withColumn("input", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("result_coverage")
def result_coverage(cat: Catalog) -> DataFrame:
    names = ["mart_shipment_daily", "mart_pnl_revenue", "mart_pnl_cogs", "mart_pnl_gross_margin"]
    return _coverage_rows(cat, {n: apply_filters(cat[n], n, *SPRING) for n in names})


# input: (state it is in, notice key, tone)
NOTICES = [
    ("mart_inventory_onhand", "NO_DATA", "inventory", "critical"),
    ("mart_inventory_onhand", "PARTIAL", "inventory-partial", "warning"),
    ("mart_open_po", "NO_DATA", "po", "info"),
    ("mart_shipment_daily", "NO_DATA", "shipment", "warning"),
    ("mart_return_analysis", "NO_DATA", "return", "info"),
    ("mart_pnl_revenue", "NO_DATA", "sales", "critical"),
    ("mart_pnl_revenue", "PARTIAL", "sales-partial", "warning"),
    ("mart_pnl_cogs", "NO_DATA", "cogs", "critical"),
    ("mart_pnl_cogs", "PARTIAL", "cogs-partial", "warning"),
    ("mart_pnl_contribution", "NO_DATA", "charge", "warning"),
    ("mart_pnl_contribution", "PARTIAL", "charge-partial", "warning"),
]


@query("missing_input_notices")
def missing_input_notices(cat: Catalog) -> DataFrame:
    """What the overview pages should say is absent or partial in the chosen range."""
    late = (dt.date(2001, 10, 1), dt.date(2001, 12, 31))
    names = dict.fromkeys(n for n, *_ in NOTICES)
    frames = {n: apply_filters(cat[n], n, *late) for n in names if n != "mart_inventory_onhand"}
    # The inventory notice needs rows only, so it reads the snapshot instead of ranking lots.
    snapshot = cat["fact_inventory_snapshot"]
    frames["mart_inventory_onhand"] = apply_filters(snapshot, "mart_inventory_onhand", *late)
    frames["mart_open_po"] = frames["mart_open_po"].filter("qty_open > 0")
    rules = literal_table(cat.spark, ["input", "coverage_flag", "notice", "tone"], NOTICES)
    return _coverage_rows(cat, frames).join(rules, ["input", "coverage_flag"]).select("input", "notice", "tone")


# ---- inventory ----------------------------------------------------------
@query("kpi_inventory_summary")
def kpi_inventory_summary(cat: Catalog) -> DataFrame:
    return cat["lots"].groupBy("snapshot_date", "warehouse_id", "item_id").agg(
        *[sum0(c).alias(c) for c in ("onhand_qty", "sellable_qty", "blocked_qty", "expired_qty")],
        F.count(F.lit(1)).alias("lot_count"))


@query("kpi_inventory")
def kpi_inventory(cat: Catalog) -> DataFrame:
    total = cat["kpi_inventory_summary"].agg(
        sum0("onhand_qty").alias("total_onhand"), sum0("sellable_qty").alias("total_sellable"),
        sum0("blocked_qty").alias("total_blocked"), sum0("expired_qty").alias("total_expired"),
        F.count_distinct("warehouse_id", "item_id").alias("unique_items"),
        exact_avg("lot_count").alias("avg_lots_per_item"))
    return total.withColumn("sellable_rate", ratio(F.col("total_sellable") * 100, F.col("total_onhand")))


@query("kpi_inventory_by_warehouse")
def kpi_inventory_by_warehouse(cat: Catalog) -> DataFrame:
    return cat["lots"].groupBy("warehouse_id").agg(
        sum0("sellable_qty").alias("sellable"), sum0("blocked_qty").alias("blocked"),
        sum0("expired_qty").alias("expired"))


@query("kpi_turnover")
def kpi_turnover(cat: Catalog) -> DataFrame:
    return cat["mart_inventory_turnover"].agg(
        rate_avg("turnover_ratio").alias("avg_turnover"), rate_avg("days_on_hand").alias("avg_days_on_hand"),
        F.count_if(F.col("days_on_hand") > 90).alias("slow_movers"), F.count_distinct("item_id").alias("total_items"))


@query("kpi_turnover_trend")
def kpi_turnover_trend(cat: Catalog) -> DataFrame:
    return cat["mart_inventory_turnover"].filter("turnover_ratio IS NOT NULL").groupBy("period").agg(
        (F.floor(rate_avg("turnover_ratio") * 100 + 0.5) / 100).alias("turnover_ratio"))


@query("kpi_turnover_ranking")
def kpi_turnover_ranking(cat: Catalog) -> DataFrame:
    """Slowest movers first; a total order over the whole mart, sorted in ranges."""
    return cat["mart_inventory_turnover"].filter("turnover_ratio IS NOT NULL").orderBy(
        "turnover_ratio", "item_id", "warehouse_id", "period")


def _out_of_stock() -> Column:
    return F.coalesce("sellable_qty", F.lit(0.0)) <= 0


@query("kpi_stockout")
def kpi_stockout(cat: Catalog) -> DataFrame:
    """Cover figures over items with demand; without demand cover is infinite and has no mean."""
    demand = F.col("avg_daily_demand") > 0
    cover, limit = F.when(demand, F.col("days_of_cover")), F.col("threshold_days")
    return cat["mart_stockout_risk"].agg(
        F.count_if(_out_of_stock()).alias("stockout_count"),
        F.count_if(F.col("risk_flag") & ~_out_of_stock()).alias("risk_count"),
        rate_avg(cover).alias("avg_days_of_cover"),
        F.count_if(F.col("days_of_cover") <= limit).alias("at_or_below_threshold"),
        rate_avg(cover - limit).alias("avg_gap_to_threshold"))


@query("kpi_stockout_lowest")
def kpi_stockout_lowest(cat: Catalog) -> DataFrame:
    return cat["mart_stockout_risk"].select("item_id", "warehouse_id", "days_of_cover", "threshold_days").orderBy(
        "days_of_cover", "item_id", "warehouse_id").limit(20)


# ---- procurement --------------------------------------------------------
@query("kpi_open_po_rows")
def kpi_open_po_rows(cat: Catalog) -> DataFrame:
    """Open purchase-order lines with their status label."""
    status = F.when(F.col("qty_open") <= 0, "closed").when(F.col("delay_days") > 0, "late").when(
        F.col("first_receipt_date").isNotNull(), "partly received").otherwise("in progress")
    return cat["mart_open_po"].filter("qty_open > 0").select(
        "po_id", "item_id", "eta_date", "qty_open", "delay_days", status.alias("status"),
    ).orderBy(F.asc_nulls_last("eta_date"), F.desc("qty_open"), "po_id")


@query("kpi_open_po")
def kpi_open_po(cat: Catalog) -> DataFrame:
    late = F.col("delay_days") > 0
    return cat["mart_open_po"].filter("qty_open > 0").agg(
        F.count(F.lit(1)).alias("open_count"), sum0("qty_open").alias("open_qty"),
        F.count_if(late).alias("delayed_count"), sum0(F.when(late, F.col("qty_open"))).alias("overdue_qty"),
        exact_avg("po_lead_days").alias("avg_lead_days"),
        F.count("first_receipt_date").alias("partial_receipt_count"))


@query("kpi_lead_time")
def kpi_lead_time(cat: Catalog) -> DataFrame:
    return cat["lead_time_analysis"].agg(
        F.count_distinct("supplier_id").alias("supplier_count"), F.sum("total_count").alias("total_samples"),
        *[weighted_avg(c, "total_count").alias(c)
          for c in ("avg_lead_days", "median_lead_days", "avg_delay_days", "late_po_ratio")])


@query("kpi_lead_time_top")
def kpi_lead_time_top(cat: Catalog) -> DataFrame:
    return cat["lead_time_analysis"].select(
        "period", "supplier_id", "item_id", "total_count", "avg_lead_days", "avg_delay_days",
    ).orderBy(F.desc("total_count"), "supplier_id", "item_id", "period").limit(8)


# ---- shipments and returns ----------------------------------------------
@query("kpi_shipment_return")
def kpi_shipment_return(cat: Catalog) -> DataFrame:
    out = cat["mart_shipment_daily"].agg(
        sum0("qty_shipped").alias("shipped_qty"), F.sum("shipment_count").alias("shipment_count"),
        exact_avg("qty_shipped").alias("avg_daily_shipment"))
    back = cat["mart_return_analysis"].agg(
        sum0("qty_returned").alias("returned_qty"), F.sum("return_count").alias("return_count"),
        sum0("qty_shipped").alias("_basis"))
    return side_by_side(out, back).withColumn(
        "return_rate", ratio(F.col("returned_qty"), F.col("_basis"))).drop("_basis")


@query("kpi_shipment_trend")
def kpi_shipment_trend(cat: Catalog) -> DataFrame:
    return cat["mart_shipment_daily"].groupBy(bucket(F.col("ship_date"), "week").alias("week")).agg(
        sum0("qty_shipped").alias("shipped_qty"))


@query("kpi_return_reasons")
def kpi_return_reasons(cat: Catalog) -> DataFrame:
    return cat["mart_return_analysis"].groupBy(F.coalesce("reason", F.lit("unclassified")).alias("reason")).agg(
        sum0("qty_returned").alias("qty_returned"), F.sum("return_count").alias("return_count"),
        sum0("qty_shipped").alias("qty_shipped"),
    ).withColumn("return_rate", ratio(F.col("qty_returned"), F.col("qty_shipped")))


@query("kpi_constraints")
def kpi_constraints(cat: Catalog) -> DataFrame:
    level = F.col("severity")
    return cat["mart_constraint_signals"].agg(
        F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "WARN").alias("warn"), F.count_distinct("domain").alias("domains"))


@query("kpi_scm_overview")
def kpi_scm_overview(cat: Catalog) -> DataFrame:
    stock = cat["lots"].agg(sum0("sellable_qty").alias("total_sellable"), sum0("blocked_qty").alias("total_blocked"))
    risk = cat["mart_stockout_risk"].agg(
        F.count_if(_out_of_stock() | F.col("risk_flag")).alias("risky_items"),
        F.count_if(F.col("days_of_cover") <= F.col("threshold_days")).alias("at_or_below_threshold"))
    po = cat["mart_open_po"].filter("qty_open > 0").agg(
        sum0("qty_open").alias("open_po_qty"), F.count_if(F.col("delay_days") > 0).alias("delayed_po_count"))
    ship = cat["mart_shipment_daily"].agg(
        sum0("qty_shipped").alias("shipped_qty"), F.sum("shipment_count").alias("shipment_count"),
        exact_avg("qty_shipped").alias("avg_daily_shipment"))
    back = cat["mart_return_analysis"].agg(sum0("qty_returned").alias("_returned"))
    return side_by_side(stock, risk, po, ship, back).withColumn(
        "return_rate", ratio(F.col("_returned") * 100, F.col("shipped_qty"))).drop("_returned")


# ---- profit and loss ----------------------------------------------------
@query("kpi_revenue")
def kpi_revenue(cat: Catalog) -> DataFrame:
    """Totals stay unknown when every line is unknown."""
    total = cat["mart_pnl_revenue"].agg(
        *[exact_sum(f"{c}_krw").alias(c) for c in ("gross_sales", "discounts", "refunds", "net_revenue")],
        F.count_distinct(F.coalesce("channel_store_id", F.lit("UNKNOWN"))).alias("channels"),
        F.count_distinct(F.coalesce("country", F.lit("UNKNOWN"))).alias("countries"))
    return total.withColumn("net_rate", ratio(F.col("net_revenue") * 100, F.col("gross_sales")))


def revenue_trend(revenue: DataFrame) -> DataFrame:
    """(period, by_channel, net_revenue_krw): every channel's revenue, as (channel, value) in order of the channel.

    Channels are whatever a month has; none has to be listed beforehand. Rows without a
    channel count as ``UNKNOWN``.
    """
    known = revenue.filter("net_revenue_krw IS NOT NULL").groupBy(
        "period", F.coalesce("channel_store_id", F.lit("UNKNOWN")).alias("channel")).agg(F.sum(F.col("net_revenue_krw").cast(MONEY)).alias("_v"))
    return known.groupBy("period").agg(
        by_value(F.struct("channel", F.col("_v").cast("double").alias("net_revenue_krw"))).alias("by_channel"),
        F.sum("_v").cast("double").alias("net_revenue_krw"))


@query("kpi_revenue_trend")
def kpi_revenue_trend(cat: Catalog) -> DataFrame:
    """One row per month and channel, out of the months' maps; an absent channel has no row."""
    wide = revenue_trend(cat["mart_pnl_revenue"])
    return wide.select("period", F.col("net_revenue_krw").alias("month_revenue_krw"), F.inline("by_channel"))


@query("kpi_revenue_by_country")
def kpi_revenue_by_country(cat: Catalog) -> DataFrame:
    return cat["mart_pnl_revenue"].groupBy(F.coalesce("country", F.lit("UNKNOWN")).alias("country")).agg(
        sum0("net_revenue_krw").alias("net_revenue_krw"),
        F.bool_or(F.coalesce(F.col("coverage_flag") != "ACTUAL", F.lit(True))).alias("partial"))


def _partial() -> Column:
    return F.count_if(F.coalesce(F.col("coverage_flag"), F.lit("PARTIAL")) != "ACTUAL").alias("partial_rows")


@query("kpi_cogs")
def kpi_cogs(cat: Catalog) -> DataFrame:
    total = cat["mart_pnl_cogs"].agg(
        sum0("qty_net").alias("qty_net"), rate_avg("unit_cost_krw").alias("avg_unit_cost"),
        exact_sum("cogs_krw").alias("total_cogs"), _partial(), sum0("qty_shipped").alias("_out"),
        sum0("qty_returned").alias("_back"))
    return total.withColumn("return_rate", ratio(F.col("_back") * 100, F.col("_out"))).drop("_out", "_back")


@query("kpi_contribution")
def kpi_contribution(cat: Catalog) -> DataFrame:
    value = F.col("contribution_krw")
    return cat["mart_pnl_contribution"].agg(
        sum0("contribution_krw").alias("total_contribution"),
        sum0("total_variable_cost_krw").alias("total_variable_cost"),
        F.count_if(value > 0).alias("positive_rows"), F.count_if(value < 0).alias("negative_rows"),
        rate_avg("contribution_pct").alias("avg_contribution_pct"), _partial())


@query("kpi_contribution_by_channel")
def kpi_contribution_by_channel(cat: Catalog) -> DataFrame:
    return cat["mart_pnl_contribution"].groupBy(
        F.coalesce("channel_store_id", F.lit("unclassified")).alias("channel"),
    ).agg(sum0("contribution_krw").alias("contribution"), sum0("total_variable_cost_krw").alias("variable_cost"))


@query("kpi_operating_profit")
def kpi_operating_profit(cat: Catalog) -> DataFrame:
    value = F.col("operating_profit_krw")
    total = cat["mart_pnl_operating_profit"].agg(
        sum0("operating_profit_krw").alias("total_profit"), _partial(), F.count(F.lit(1)).alias("rows"),
        F.count_if(value > 0).alias("profitable_rows"), F.count_if(value < 0).alias("loss_rows"),
        rate_avg("operating_profit_pct").alias("avg_margin"))
    return total.withColumn("partial_share", ratio(F.col("partial_rows").cast("double"), F.col("rows")))


@query("kpi_operating_profit_trend")
def kpi_operating_profit_trend(cat: Catalog) -> DataFrame:
    return cat["mart_pnl_operating_profit"].groupBy(F.substring("period", 1, 4).alias("year")).agg(
        sum0("operating_profit_krw").alias("operating_profit"))


RANK_ORDER = ["rank_by_contribution", "period"]


@query("kpi_profitability_top")
def kpi_profitability_top(cat: Catalog) -> DataFrame:
    return cat["profitability_ranking"].select(
        "period", "item_id", "channel_store_id", "contribution_krw", "rank_by_contribution",
    ).orderBy(*RANK_ORDER).limit(10)


@query("kpi_profitability")
def kpi_profitability(cat: Catalog) -> DataFrame:
    top = cat["kpi_profitability_top"].agg(
        F.min_by("item_id", F.struct(*RANK_ORDER)).alias("top_item"),
        sum0("contribution_krw").alias("top_ten_contribution"))
    total = cat["profitability_ranking"].agg(
        rate_avg("contribution_pct").alias("avg_contribution_pct"),
        rate_avg("gross_margin_pct").alias("avg_gross_margin_pct"),
        F.count_if(F.col("contribution_krw") > 0).alias("profitable_rows"), F.count(F.lit(1)).alias("rows"))
    return side_by_side(top, total)


@query("kpi_pnl_overview")
def kpi_pnl_overview(cat: Catalog) -> DataFrame:
    revenue = cat["mart_pnl_revenue"].agg(
        sum0("net_revenue_krw").alias("net_revenue"),
        sum0(F.coalesce("discounts_krw", F.lit(0.0)) + F.coalesce("refunds_krw", F.lit(0.0))).alias("discount_and_refund"))
    cogs = cat["mart_pnl_cogs"].agg(sum0("cogs_krw").alias("total_cogs"))
    profit = cat["mart_pnl_operating_profit"].agg(
        sum0("contribution_krw").alias("total_contribution"), sum0("operating_profit_krw").alias("total_profit"),
        F.count_if(F.col("operating_profit_krw") < 0).alias("loss_rows"))
    return side_by_side(revenue, cogs, profit).withColumn(
        "operating_margin", ratio(F.col("total_profit") * 100, F.col("net_revenue")))


# ---- anomalies ----------------------------------------------------------
@query("anomaly_banner")
def anomaly_banner(cat: Catalog) -> DataFrame:
    level = F.col("severity")
    return cat["mart_anomaly_signals"].agg(
        F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"),
        F.count(F.lit(1)).alias("total"))


@query("anomaly_banner_preview")
def anomaly_banner_preview(cat: Catalog) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), F.col("severity"))
    return cat["mart_anomaly_signals"].orderBy(
        order, F.desc(F.bround(F.abs("deviation"), 6)), "metric_name", "entity_id", "period").limit(3).select(
        "severity", "metric_name", "entity_id", "period")
