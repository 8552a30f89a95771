"""Forecast accuracy, supplier and item grading, comparisons and free reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import (
    MONEY, by_value, days_between, exact_avg, exact_sum, month, rate_avg, ratio, side_by_side, sum0,
)
from ledgerloom.operators.alerts import suppress
from ledgerloom.operators.ranking import falling_bucket, running_sum_in_steps
from ledgerloom.sources.canonical import share_lines


# ---- forecasts ----------------------------------------------------------
@table("shipped_monthly")
def shipped_monthly(cat: Catalog) -> DataFrame:
    return cat["fact_shipment"].groupBy(month("ship_date").alias("period"), "item_id", "warehouse_id").agg(
        exact_sum("qty_shipped").alias("actual_qty"))


@table("fact_demand_forecast")
def fact_demand_forecast(cat: Catalog) -> DataFrame:
    """Stand-in forecasts: each method misses the shipped quantity by a share that depends on the item."""
    k = (F.col("item_id").cast("int") % 5).cast("double")
    methods = F.array(
        F.struct(F.lit("NAIVE_AVG").alias("forecast_method"), (F.col("actual_qty") * (k * 0.1 + 0.8)).alias("forecast_qty")),
        F.struct(F.lit("PROPHET").alias("forecast_method"), (F.col("actual_qty") * (k * 0.05 + 0.9)).alias("forecast_qty")))
    return cat["shipped_monthly"].select("period", "item_id", "warehouse_id", F.inline(methods))


@query("forecast_accuracy")
def forecast_accuracy(cat: Catalog) -> DataFrame:
    keys = ["period", "item_id", "warehouse_id"]
    planned = cat["fact_demand_forecast"].groupBy(*keys, "forecast_method").agg(
        exact_sum("forecast_qty").alias("forecast_qty"))
    error = F.col("forecast_qty") - F.col("actual_qty")
    df = planned.join(cat["shipped_monthly"], keys).withColumns({"error_qty": error, "abs_error": F.abs(error)})
    df = df.withColumns({
        "mape": ratio(F.col("abs_error"), F.col("actual_qty")), "bias": ratio(F.col("error_qty"), F.col("actual_qty"))})
    return df.withColumn("accuracy_pct", F.greatest(F.lit(1.0) - F.col("mape"), F.lit(0.0)) * 100)


def trend(now: Column, before: Column, tolerance: float) -> Column:
    """Error trend; changes inside the tolerance are stable, no history is unknown."""
    return F.when(now < before * (1 - tolerance), "IMPROVING").when(
        now > before * (1 + tolerance), "DEGRADING").when(before.isNotNull(), "STABLE")


@query("model_performance")
def model_performance(cat: Catalog, tolerance: float = 0.05, drift: float = 0.02) -> DataFrame:
    """Rank of each method per month and warehouse against the month before."""
    keys = ["warehouse_id", "forecast_method"]
    df = cat["forecast_accuracy"].groupBy("period", *keys).agg(
        rate_avg("mape").alias("mape"), rate_avg("bias").alias("bias"))
    following = month(F.add_months(F.concat("period", F.lit("-01")).cast("date"), 1))
    before = df.select(following.alias("period"), *keys, F.col("mape").alias("mape_prev_period"))
    w = Window.partitionBy("period", "warehouse_id").orderBy("mape", "forecast_method")
    now, prev = F.col("mape"), F.col("mape_prev_period")
    return df.join(before, ["period", *keys], "left").withColumn("rank_in_period", F.row_number().over(w)).withColumns({
        "is_champion": F.col("rank_in_period") == 1, "mape_trend": trend(now, prev, tolerance),
        "drift_detected": F.coalesce(now - prev > drift, F.lit(False))})


@table("fact_lead_time_forecast")
def fact_lead_time_forecast(cat: Catalog) -> DataFrame:
    days = (F.col("supplier_id").cast("int") % 5 + 18).cast("double")
    return cat["fact_po"].select(month("po_date").alias("period"), "supplier_id", days.alias("predicted_lead_days")).distinct()


@query("lead_time_vs_prediction")
def lead_time_vs_prediction(cat: Catalog) -> DataFrame:
    got = cat["fact_receipt"].select("po_id", "item_id", "receipt_date")
    df = cat["fact_po"].join(got, ["po_id", "item_id"]).select(
        month("po_date").alias("period"), "supplier_id", days_between("receipt_date", "po_date").alias("lead"),
        (F.col("receipt_date") > F.col("eta_date")).alias("late"))
    actual = df.groupBy("period", "supplier_id").agg(
        exact_avg("lead").alias("actual_lead_days_avg"), F.percentile("lead", 0.5).alias("actual_lead_days_p50"),
        F.percentile("lead", 0.9).alias("actual_lead_days_p90"),
        (F.count_if("late") / F.count(F.lit(1))).alias("late_po_ratio"), F.count(F.lit(1)).alias("total_po_count"))
    planned = cat["fact_lead_time_forecast"].groupBy("period", "supplier_id").agg(
        exact_avg("predicted_lead_days").alias("predicted_lead_days_avg"))
    return actual.join(planned, ["period", "supplier_id"], "left").withColumn(
        "prediction_error_days", F.col("actual_lead_days_avg") - F.col("predicted_lead_days_avg"))


@query("kpi_forecast")
def kpi_forecast(cat: Catalog) -> DataFrame:
    """Accuracy, urgent orders, quantity to order and lead-time error."""
    share_lines(cat)
    accuracy = cat["forecast_accuracy"].agg(rate_avg("accuracy_pct").alias("avg_accuracy"))
    risk = cat["mart_stockout_risk"].filter("risk_flag")
    order = F.greatest(F.col("avg_daily_demand") * F.col("threshold_days") - F.col("sellable_qty"), F.lit(0.0))
    plan = risk.agg(F.count(F.lit(1)).alias("urgent_orders"), sum0(order).alias("recommended_qty"))
    lead = cat["lead_time_vs_prediction"].agg(rate_avg(F.abs("prediction_error_days")).alias("avg_lead_error"))
    return side_by_side(accuracy, plan, lead)


# ---- grading ------------------------------------------------------------
@query("abc_classification")
def abc_classification(cat: Catalog) -> DataFrame:
    """Items by share of the month's revenue: A to 80 %, B to 95 %, C beyond."""
    items = cat["mart_pnl_revenue"].filter("net_revenue_krw IS NOT NULL").groupBy("period", "item_id").agg(
        F.sum(F.col("net_revenue_krw").cast(MONEY)).alias("_rev"))
    score = F.col("_rev").cast("double")
    ranked = running_sum_in_steps(
        items.withColumn("_step", falling_bucket(score)), ["period"], "_step",
        [F.desc("_rev"), "item_id"], F.col("_rev"), "_upto")
    total = items.groupBy("period").agg(F.sum("_rev").alias("_total"))
    share = F.try_divide(F.col("_upto").cast("double") * 100, F.col("_total").cast("double"))
    return ranked.join(total, "period").select(
        "period", "item_id", score.alias("revenue_krw"), share.alias("cumulative_pct"),
        F.when(share <= 80, "A").when(share <= 95, "B").otherwise("C").alias("abc_grade"))


@query("supplier_scorecard")
def supplier_scorecard(cat: Catalog, steady_days: float = 10.0) -> DataFrame:
    """Delivery 40, fill rate 30, lead-time stability 30; a spread of ``steady_days`` scores zero stability."""
    got = cat["fact_receipt"].groupBy("po_id", "item_id").agg(
        exact_sum("qty_received").alias("got"), F.min("receipt_date").alias("first"))
    df = cat["fact_po"].join(got, ["po_id", "item_id"], "left").withColumn("lead", days_between("first", "po_date"))
    lead = F.col("lead").cast("bigint")
    out = df.groupBy(month("po_date").alias("period"), "supplier_id").agg(
        F.count(F.lit(1)).alias("total_po_count"), F.count_if(F.col("first") <= F.col("eta_date")).alias("on_time_count"),
        exact_avg("lead").alias("avg_lead_days"), F.count(lead).alias("_n"), F.sum(lead).alias("_s"),
        F.sum(lead * lead).alias("_ss"), exact_sum("qty_ordered").alias("qty_ordered"), sum0("got").alias("qty_received"))
    spread = (F.col("_n") * F.col("_ss") - F.col("_s") * F.col("_s")).cast("double")
    pairs = (F.col("_n") * (F.col("_n") - 1)).cast("double")
    out = out.withColumns({
        "on_time_rate": F.col("on_time_count") / F.col("total_po_count"),
        "lead_time_stddev": F.when(F.col("_n") > 1, F.sqrt(spread / pairs)),
        "fill_rate": ratio(F.col("qty_received"), F.col("qty_ordered")),
    }).drop("_n", "_s", "_ss")
    steady = F.greatest(F.lit(1.0) - F.coalesce("lead_time_stddev", F.lit(0.0)) / steady_days, F.lit(0.0))
    filled = F.least(F.coalesce("fill_rate", F.lit(0.0)), F.lit(1.0))
    return out.withColumn("overall_score", F.col("on_time_rate") * 40 + filled * 30 + steady * 30)


@query("channel_profitability")
def channel_profitability(cat: Catalog) -> DataFrame:
    keys = ["period", "channel_store_id"]
    margin = cat["mart_pnl_gross_margin"].groupBy(*keys).agg(
        exact_sum("net_revenue_krw").alias("net_revenue_krw"), exact_sum("cogs_krw").alias("cogs_krw"),
        exact_sum("gross_margin_krw").alias("gross_margin_krw"))
    rest = cat["mart_pnl_contribution"].groupBy(*keys).agg(
        exact_sum("total_variable_cost_krw").alias("variable_cost_krw"),
        exact_sum("contribution_krw").alias("contribution_krw"))
    return margin.join(rest, keys, "left").withColumn(
        "contribution_pct", ratio(F.col("contribution_krw"), F.col("net_revenue_krw")))


# ---- comparison and reports ---------------------------------------------
@query("period_comparison")
def period_comparison(cat: Catalog) -> DataFrame:
    """Shipped quantity per store against the month, quarter or year before."""
    monthly = cat["fact_shipment"].groupBy(F.trunc("ship_date", "month").alias("_m"), "channel_store_id").agg(
        exact_sum("qty_shipped").alias("_q"))
    out = None
    for grain, months in (("month", 1), ("quarter", 3), ("year", 12)):
        now = monthly.groupBy(F.trunc("_m", grain).alias("bucket"), "channel_store_id").agg(
            exact_sum("_q").alias("current_qty"))
        before = now.select(F.add_months("bucket", months).alias("bucket"), "channel_store_id",
                            F.col("current_qty").alias("previous_qty"))
        both = now.join(before, ["bucket", "channel_store_id"], "left").withColumn("grain", F.lit(grain))
        out = both if out is None else out.unionByName(both)
    change = F.col("current_qty") - F.col("previous_qty")
    return out.withColumns({"change_qty": change, "change_pct": ratio(change * 100, F.col("previous_qty"))})


@query("filter_options")
def filter_options(cat: Catalog) -> DataFrame:
    """Values a picker can offer; each source is made distinct before the union."""
    out = None
    for kind in ("warehouse_id", "item_id", "channel_store_id"):
        one = cat["fact_shipment"].select(F.lit(kind).alias("kind"), F.col(kind).alias("value")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.filter("value IS NOT NULL")


def report(
    df: DataFrame, axes: list[str], measures: dict[str, tuple[str, str]], pivot: str | None = None,
) -> DataFrame:
    """Chosen axes by chosen measures (name: column, ``sum`` or ``avg``).

    With ``pivot`` a row has the array ``by_<pivot>`` of (value, measures), every value in it, in order.
    """
    how = {"sum": exact_sum, "avg": exact_avg}
    aggs = [how[kind](c).alias(name) for name, (c, kind) in measures.items()]
    grouped = df.groupBy(*axes, *([pivot] if pivot else [])).agg(*aggs)
    if not pivot:
        return grouped
    return grouped.groupBy(*axes).agg(by_value(F.struct(pivot, *measures)).alias(f"by_{pivot}"))


@query("custom_report")
def custom_report(cat: Catalog) -> DataFrame:
    df = cat["fact_shipment"].withColumn("period", month("ship_date"))
    wide = report(df, ["period", "channel_store_id"], {"qty": ("qty_shipped", "sum"), "mean": ("qty_shipped", "avg")}, "warehouse_id")
    return wide.select("period", "channel_store_id", F.size("by_warehouse_id").alias("warehouses"), F.inline("by_warehouse_id"))


@query("dq_report_summary")
def dq_report_summary(cat: Catalog) -> DataFrame:
    return cat["dq_report"].groupBy("file_name", "severity").agg(
        F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"))


@query("alert_dedup")
def alert_dedup(cat: Catalog) -> DataFrame:
    """Alerts on events: one per user and event type in 24 hours, with how many it stands for."""
    return suppress(cat.source("events"), ["event_type", "user_id"], "ts", "event_id")


@query("alert_dedup_signals")
def alert_dedup_signals(cat: Catalog) -> DataFrame:
    """Alerts on both signal marts: one per metric and entity in 24 hours, named by its first period."""
    columns = ["metric_name", "entity_type", "entity_id", "period", "detected_at"]
    both = cat["mart_anomaly_signals"].select(*columns).unionByName(cat["mart_constraint_signals"].select(*columns))
    return suppress(both, columns[:3], "detected_at", "period")
