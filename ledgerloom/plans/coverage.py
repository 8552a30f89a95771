"""Data coverage per period, period close, and post-close adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import month
from ledgerloom.operators.ranking import row_number_in_steps

MIN_ROWS = 1


@table("period_events")
def period_events(cat: Catalog) -> DataFrame:
    """Close, reopen and forced re-close events, derived from the months ordered in.

    Months up to 1998 are closed; May and October are reopened; October is
    closed again.
    """
    periods = cat["fact_order"].select(
        month("order_date").alias("period"), F.last_day("order_date").alias("_end")).distinct()
    number = F.month("_end")

    def event(kind: str, days: int, by: str):
        return F.struct(F.lit(kind).alias("event"), F.date_add("_end", days).alias("at"), F.lit(by).alias("actor"))

    closed, reopened, again = event("close", 10, "controller"), event("reopen", 20, "auditor"), event("close", 30, "force")
    events = F.when(number == 10, F.array(closed, reopened, again)).when(
        number == 5, F.array(closed, reopened)).otherwise(F.array(closed))
    return periods.filter("year(_end) <= 1998").select("period", F.inline(events))


@query("period_state")
def period_state(cat: Catalog) -> DataFrame:
    """Whether each period is locked: its latest event decides."""
    return cat["period_events"].groupBy("period").agg(
        F.max_by(F.col("event") == "close", "at").alias("lock_flag"),
        F.max(F.when(F.col("event") == "close", F.col("at"))).alias("closed_at"),
        F.max_by("actor", "at").alias("last_actor"))


@table("closed_periods")
def closed_periods(cat: Catalog) -> DataFrame:
    return cat["period_state"].filter("lock_flag").select("period")


@query("period_gate")
def period_gate(cat: Catalog) -> DataFrame:
    """Order lines with the verdict of the closed-period check."""
    rows = cat["fact_order"].select("channel_order_id", "line_no", month("order_date").alias("period"))
    closed = cat["closed_periods"].withColumn("_closed", F.lit(True))
    return rows.join(closed, "period", "left").select(
        "channel_order_id", "line_no", "period", F.col("_closed").isNull().alias("accepted"))


def split_by_gate(df: DataFrame, closed: DataFrame, period: str = "period") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; ``closed`` holds one row per locked period."""
    closed = closed.select(F.col("period").alias(period))
    return df.join(closed, period, "left_anti"), df.join(closed, period, "left_semi")


@table("periods_seen")
def periods_seen(cat: Catalog) -> DataFrame:
    parts = [
        cat["fact_order"].select(month("order_date").alias("period")),
        cat["fact_shipment"].select(month("ship_date").alias("period")),
        cat["fact_charge_actual"].select("period"),
        cat["fact_settlement"].select("period"),
    ]
    # Distinct inside each source first, so only a few hundred rows meet in the union.
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.union(p.distinct())
    return out.filter("period IS NOT NULL AND period <> ''").distinct()


@table("domain_counts")
def domain_counts(cat: Catalog) -> DataFrame:
    """Rows per coverage domain and period; cost structures count for every period."""
    n = F.count(F.lit(1)).alias("n")
    fx = cat["fact_exchange_rate"].groupBy("period").agg(n).withColumn("domain", F.lit("fx_rate"))
    settled = cat["fact_settlement"].groupBy("period").agg(n).withColumn("domain", F.lit("revenue_settlement"))
    cost = cat["fact_cost_structure"].agg(n).select(
        F.lit("ALL").alias("period"), "n", F.lit("cost_structure").alias("domain"))
    kinds = cat.policy.charge_policy(cat.spark).select("charge_type", F.col("charge_domain").alias("domain"))
    charged = cat["fact_charge_actual"].join(F.broadcast(kinds), "charge_type").groupBy("domain", "period").agg(n)
    return fx.unionByName(settled).unionByName(cost).unionByName(charged)


def _requirement_rows(cat: Catalog) -> list[tuple]:
    p = cat.policy
    return [
        (d, req == "REQUIRED", p.close_enforcement.get(d, req) == "REQUIRED", d in p.close_enforcement)
        for d, req in p.coverage_domains.items()
    ]


@query("mart_coverage_period")
def mart_coverage_period(cat: Catalog) -> DataFrame:
    rows = _requirement_rows(cat)
    domains = F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(o).alias("_open"), F.lit(c).alias("_close")) for d, o, c, _ in rows])
    grid = cat["periods_seen"].select("period", F.inline(domains))
    counts = cat["domain_counts"]
    exact = counts.filter("period <> 'ALL'")
    always = counts.filter("period = 'ALL'").select("domain", F.col("n").alias("_all"))
    closed = cat["closed_periods"].withColumn("_closed", F.lit(True))
    df = grid.join(exact, ["period", "domain"], "left").join(always, "domain", "left").join(closed, "period", "left")
    included = F.coalesce("n", "_all", F.lit(0)).cast("bigint")
    is_closed = F.coalesce("_closed", F.lit(False))
    full = included >= MIN_ROWS
    needed = F.when(is_closed, F.col("_close")).otherwise(F.col("_open"))
    return df.select(
        "period", "domain", F.when(full, F.lit(1.0)).otherwise(F.lit(0.0)).alias("coverage_rate"),
        included.alias("included_rows"),
        F.when(full, F.lit(0)).otherwise(F.lit(MIN_ROWS) - included).cast("bigint").alias("missing_rows"),
        F.when(full, "OK").when(needed, "CRITICAL").otherwise("INFO").alias("severity"),
        is_closed.alias("is_closed_period"))


@query("closed_period_gaps")
def closed_period_gaps(cat: Catalog) -> DataFrame:
    """Domains a closed period must have and does not."""
    enforced = [d for d, r in cat.policy.close_enforcement.items() if r == "REQUIRED"]
    return cat["mart_coverage_period"].filter(
        F.col("is_closed_period") & (F.col("coverage_rate") < 1.0) & F.col("domain").isin(enforced),
    ).select(
        "period", "domain",
        F.concat(
            F.lit("REQUIRED domain '"), "domain", F.lit("' has insufficient data for closed period '"), "period",
            F.lit("' (found "), F.col("included_rows"), F.lit(f" rows, need >= {MIN_ROWS})")).alias("message"))


@table("late_changes")
def late_changes(cat: Catalog) -> DataFrame:
    """Superseded line versions: what a later load would change in an order line."""
    kept = cat["li"].select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("_new"), F.col("l_shipdate").alias("changed_on"))
    every = cat.source("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("_old_ship")).distinct()
    return every.join(kept, ["l_orderkey", "l_linenumber"]).filter("l_quantity <> _new").select(
        month("_old_ship").alias("period"), "changed_on",
        F.lit("fact_order").alias("table_name"),
        F.concat("l_orderkey", F.lit("|"), "l_linenumber").alias("business_key"),
        F.lit("qty_ordered").alias("field_name"),
        F.col("l_quantity").cast("bigint").cast("string").alias("old_value"),
        F.col("_new").cast("bigint").cast("string").alias("new_value"),
        F.lit("late correction").alias("reason"))


def append_adjustments(changes: DataFrame, last_id: int = 0) -> DataFrame:
    """Number new entries after ``last_id`` without sorting them in one task."""
    numbered = row_number_in_steps(
        changes, [], ["period", "changed_on"],
        ["business_key", "field_name", "old_value", "new_value"], "_no")
    return numbered.select((F.lit(last_id) + F.col("_no")).cast("bigint").alias("adjustment_id"), *changes.columns)


@query("adjustment_log")
def adjustment_log(cat: Catalog) -> DataFrame:
    """Changes that hit a closed period, numbered."""
    _, locked = split_by_gate(cat["late_changes"], cat["closed_periods"])
    return append_adjustments(locked)
