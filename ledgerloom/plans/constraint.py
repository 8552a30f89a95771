"""Threshold signals, their root causes, actions and effectiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import days_between, exact_avg, exact_sum, literal_table, month
from ledgerloom.policy import ACTIONS, DEFAULT_ACTION, DEFAULT_ROOT_CAUSE, ROOT_CAUSES
from ledgerloom.session import materialize, release
from ledgerloom.sources.canonical import share_lines


def _signal(
    df: DataFrame, domain: str, metric: str, entity_type: str, entity: Column, value: Column,
    threshold: float, severity: Column,
) -> DataFrame:
    """Shape rows as signals; the id is a hash, so a rebuild repeats it."""
    key = F.concat_ws("|", F.lit(metric), entity, F.col("period"))
    return df.select(
        F.concat(F.lit("SIG-"), F.upper(F.substring(F.sha2(key, 256), 1, 16))).alias("signal_id"),
        F.lit(domain).alias("domain"), F.lit(metric).alias("metric_name"),
        value.alias("current_value"), F.lit(float(threshold)).alias("threshold_value"),
        severity.alias("severity"), F.lit(entity_type).alias("entity_type"), entity.alias("entity_id"), "period")


def _graded(value: Column, critical_from: float) -> Column:
    return F.when(value >= critical_from, "CRITICAL").otherwise("HIGH")


@query("signal_late_po")
def signal_late_po(cat: Catalog) -> DataFrame:
    limit = cat.policy.late_po_ratio
    arrived = cat["fact_receipt"].filter("po_id IS NOT NULL").select("po_id").distinct().withColumn("_in", F.lit(True))
    late = (F.col("eta_date") < F.lit(cat.policy.as_of)) & F.col("_in").isNull()
    df = cat["fact_po"].join(arrived, "po_id", "left").groupBy(
        "supplier_id", month("po_date").alias("period"),
    ).agg((F.count_if(late) / F.count(F.lit(1))).alias("share")).filter(F.col("share") >= limit)
    share = F.col("share")
    return _signal(df, "supply", "late_po_ratio", "supplier", F.col("supplier_id"),
                   F.bround(share, 4), limit, _graded(share, limit * 1.5))


@query("signal_supplier_delay")
def signal_supplier_delay(cat: Catalog) -> DataFrame:
    limit = cat.policy.supplier_delay_days
    po = cat["fact_po"].filter("eta_date IS NOT NULL").select("po_id", "item_id", "supplier_id", "po_date", "eta_date")
    got = cat["fact_receipt"].select("po_id", "item_id", "receipt_date")
    df = po.join(got, ["po_id", "item_id"]).groupBy("supplier_id", month("po_date").alias("period")).agg(
        exact_avg(days_between("receipt_date", "eta_date")).alias("delay")).filter(F.col("delay") >= limit)
    return _signal(df, "supply", "supplier_delay_days", "supplier", F.col("supplier_id"),
                   F.bround("delay", 1), limit, _graded(F.col("delay"), limit * 2))


@query("signal_backlog")
def signal_backlog(cat: Catalog) -> DataFrame:
    limit = cat.policy.backlog_orders
    shipped = cat["fact_shipment"].select("channel_order_id", "item_id")
    df = cat["fact_order"].join(shipped, ["channel_order_id", "item_id"], "left_anti").groupBy(
        F.coalesce("ship_from_warehouse_id", F.lit("UNKNOWN")).alias("warehouse_id"),
        month("order_date").alias("period"),
    ).agg(F.count(F.lit(1)).cast("double").alias("backlog")).filter(F.col("backlog") >= limit)
    return _signal(df, "warehouse_3pl", "backlog_ship_orders", "warehouse", F.col("warehouse_id"),
                   F.col("backlog"), limit, _graded(F.col("backlog"), limit * 2))


@query("signal_dwell")
def signal_dwell(cat: Catalog) -> DataFrame:
    limit = cat.policy.dwell_days
    po = cat["fact_po"].filter("eta_date IS NOT NULL").select("po_id", "item_id", "eta_date")
    got = cat["fact_receipt"].select("po_id", "item_id", "receipt_date", "warehouse_id")
    df = got.join(po, ["po_id", "item_id"]).groupBy("warehouse_id", month("receipt_date").alias("period")).agg(
        exact_avg(days_between("receipt_date", "eta_date")).alias("dwell")).filter(F.col("dwell") >= limit)
    return _signal(df, "logistics_customs", "dwell_time_days", "warehouse", F.col("warehouse_id"),
                   F.bround("dwell", 1), limit, F.lit("HIGH"))


@query("signal_return_spike")
def signal_return_spike(cat: Catalog) -> DataFrame:
    limit = cat.policy.return_spike
    returned = cat["fact_return"].groupBy(
        F.coalesce("channel_order_id", F.lit("UNKNOWN")).alias("channel"), month("return_date").alias("period"),
    ).agg(exact_sum("qty_returned").alias("returned"))
    shipped = cat["fact_shipment"].groupBy(month("ship_date").alias("period")).agg(
        exact_sum("qty_shipped").alias("shipped"))
    df = returned.join(shipped, "period", "left").withColumn(
        "rate", F.col("returned") / F.coalesce("shipped", F.lit(1.0))).filter(F.col("rate") >= limit)
    return _signal(df, "demand_channel", "return_rate_spike", "channel", F.col("channel"),
                   F.bround("rate", 4), limit, F.lit("HIGH"))


@query("signal_expired_value")
def signal_expired_value(cat: Catalog) -> DataFrame:
    # The full mart when it has been written, its lot frame otherwise: no rank is needed here.
    df = cat["lots"].filter("expired_qty > 0").groupBy(
        "item_id", "warehouse_id", F.col("snapshot_date").cast("string").alias("period"),
    ).agg(exact_sum("expired_qty").alias("expired"))
    return _signal(df, "finance", "expired_value_at_risk", "item", F.concat_ws("|", "item_id", "warehouse_id"),
                   F.col("expired"), 0.0, F.lit("CRITICAL"))


SIGNALS = ["signal_late_po", "signal_supplier_delay", "signal_backlog", "signal_dwell", "signal_return_spike",
           "signal_expired_value"]


@query("mart_constraint_signals")
def mart_constraint_signals(cat: Catalog) -> DataFrame:
    out = cat[SIGNALS[0]]
    for name in SIGNALS[1:]:
        out = out.unionByName(cat[name])
    return out.withColumn("detected_at", F.lit(cat.policy.as_of))


@query("constraint_issues")
def constraint_issues(cat: Catalog) -> DataFrame:
    """Critical signals as issue-log rows."""
    return cat["mart_constraint_signals"].filter("severity = 'CRITICAL'").select(
        F.col("signal_id").alias("issue_id"),
        F.concat(F.lit("CONSTRAINT_"), "metric_name").alias("issue_type"),
        "severity", "domain", "entity_type", "entity_id", "period",
        F.concat(F.col("metric_name"), F.lit(" exceeds threshold")).alias("detail"))


@table("ops_issue_log")
def ops_issue_log(cat: Catalog) -> DataFrame:
    """Issues of this run; those of even months stand for resolved ones."""
    issues = cat["constraint_issues"].unionByName(cat["expired_issues"])
    even = F.substring("period", 6, 2).cast("int") % 2 == 0
    return issues.withColumn("resolved_at", F.when(even, F.lit(cat.policy.as_of)))


@query("mart_constraint_root_cause")
def mart_constraint_root_cause(cat: Catalog) -> DataFrame:
    rules = literal_table(
        cat.spark, ["metric_name", "_cause", "_factors"], [(m, *pair) for m, pair in ROOT_CAUSES.items()])
    cause, factors = DEFAULT_ROOT_CAUSE
    return cat["mart_constraint_signals"].filter("severity IN ('CRITICAL', 'HIGH')").join(
        F.broadcast(rules), "metric_name", "left",
    ).select(
        "signal_id", F.coalesce("_cause", F.lit(cause)).alias("root_cause"),
        F.coalesce("_factors", F.lit(factors)).alias("contributing_factors"), "domain", "period")


@query("mart_constraint_action_plan")
def mart_constraint_action_plan(cat: Catalog) -> DataFrame:
    rules = literal_table(
        cat.spark, ["metric_name", "_action", "_priority", "_owner"], [(m, *row) for m, row in ACTIONS.items()])
    action, priority, owner = DEFAULT_ACTION
    return cat["mart_constraint_signals"].join(F.broadcast(rules), "metric_name", "left").select(
        "signal_id", F.coalesce("_action", F.lit(action)).alias("action"),
        F.coalesce("_priority", F.lit(priority)).alias("priority"),
        F.coalesce("_owner", F.lit(owner)).alias("responsible"), "domain", "period")


def share_signals(cat: Catalog) -> None:
    """Write the signals once, for a query that reads them twice.

    One kind at a time, so that the rows one of them moves are gone from the disks before the next moves its own.
    """
    if "mart_constraint_signals" in cat.notes or cat.known("mart_constraint_signals"):
        return
    share_lines(cat)
    for name in SIGNALS:
        release(cat.spark)
        cat[name] = materialize(cat[name], name)
    cat.notes["mart_constraint_signals"] = cat["mart_constraint_signals"]
    release(cat.spark)


@query("mart_constraint_effectiveness")
def mart_constraint_effectiveness(cat: Catalog) -> DataFrame:
    """Resolved issues against the signal that raised them; resolved means back to zero."""
    share_signals(cat)
    solved = cat["ops_issue_log"].filter("resolved_at IS NOT NULL").select(F.col("issue_id").alias("signal_id"))
    return cat["mart_constraint_signals"].join(solved, "signal_id").select(
        "signal_id", "metric_name", F.col("current_value").alias("before_value"),
        F.lit(0.0).alias("after_value"), (-F.col("current_value")).alias("delta"),
        F.lit(True).alias("resolved"), "period")
