"""Charge allocation and the revenue-to-operating-profit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query, table
from ledgerloom.functions.exprs import MONEY, exact_sum, flag_of_rows, month, worst_flag
from ledgerloom.operators import allocation
from ledgerloom.operators.allocation import LINE
from ledgerloom.operators.asof import asof_join
from ledgerloom.operators.ranking import falling_bucket, row_number_in_steps
from ledgerloom.session import materialize

GRAIN = ["period", "item_id", "channel_store_id"]
FULL_GRAIN = [*GRAIN, "country"]


# ---- allocation ---------------------------------------------------------
@table("rated_charges")
def rated_charges(cat: Catalog) -> DataFrame:
    """Charge lines with their rate, written once because every round reads them."""
    rates = cat["fact_exchange_rate"].select("period", "currency", "rate_to_krw")
    rate = F.when(F.col("currency") == "KRW", F.lit(1.0)).otherwise(
        F.coalesce("rate_to_krw", F.lit(cat.policy.allocation_fx_default)))
    rated = cat["fact_charge_actual"].join(rates, ["period", "currency"], "left").select(
        *LINE, "period", "currency", "amount", "warehouse_id", "channel_store_id", rate.alias("rate"))
    return materialize(rated, "charges")


def _plan(cat: Catalog) -> allocation.Plan:
    if "allocation" not in cat.notes:
        cat.notes["allocation"] = allocation.plan_allocation(
            cat["rated_charges"], cat["fact_shipment"], cat.policy, cat["fact_inventory_snapshot"])
    return cat.notes["allocation"]


def _basis(cat: Catalog) -> DataFrame:
    return allocation.plan_basis(cat["rated_charges"], cat["fact_shipment"], cat.policy, cat["fact_inventory_snapshot"])[2]


@query("allocation_basis")
def allocation_basis(cat: Catalog) -> DataFrame:
    return _basis(cat).select(
        *LINE, F.col("basis").alias("allocation_basis"),
        (F.col("total").cast("double") / allocation.UNITS).alias("basis_total"), "targets")


@query("largest_remainder")
def largest_remainder(cat: Catalog) -> DataFrame:
    """Per charge line: invoice units, sum of floors, units handed out, and the sum of the parts."""
    plan = _plan(cat)
    parts = cat["allocated_classes"].groupBy(*LINE).agg(
        F.sum(F.col("q") * F.col("n") + F.col("m")).cast("bigint").alias("allocated_units"),
        F.sum("m").cast("bigint").alias("handed_out"))
    return plan.units().select(*LINE, "units", "floor_units", "shortfall").join(parts, LINE)


@table("allocated_classes")
def allocated_classes(cat: Catalog) -> DataFrame:
    """Allocation per charge line and shipment class, with amounts in both currencies."""
    charges = cat["rated_charges"]
    placed = allocation.allocated_classes(_plan(cat), charges)
    return placed.join(charges.select(*LINE, "period", "currency", "rate"), LINE).join(
        cat.policy.charge_policy(cat.spark), "charge_type")


def _unit(cat: Catalog, units: Column) -> Column:
    return units.cast("double") / (10 ** cat.policy.allocation_decimals)


@query("mart_charge_allocated")
def mart_charge_allocated(cat: Catalog) -> DataFrame:
    """One row per charge line and shipment."""
    df = cat["allocated_classes"]
    variants = F.array(
        F.struct(F.col("q").alias("_u"), (F.col("n") - F.col("m")).alias("_copies")),
        F.struct((F.col("q") + 1).alias("_u"), F.col("m").alias("_copies")),
    )
    cut = df.select("*", F.inline(variants)).drop("q", "n", "m")
    amount = _unit(cat, F.col("_u"))
    rows = cut.select(
        "period", "charge_type", "charge_domain", "cost_stage", "invoice_no", "invoice_line_no", "item_id",
        "warehouse_id", "channel_store_id", "lot_id", F.col("basis").alias("allocation_basis"), "basis_value",
        amount.alias("allocated_amount"), (amount * F.col("rate")).alias("allocated_amount_krw"), "currency",
        "capitalizable_flag", "_copies")
    return allocation.repeat_rows(rows, "_copies")


@query("unallocated_charges")
def unallocated_charges(cat: Catalog) -> DataFrame:
    """Charges no basis could be found for, with the reason they were left out."""
    left = cat["rated_charges"].join(_basis(cat).select(*LINE), LINE, "left_anti")
    known = cat.policy.charge_policy(cat.spark).select("charge_type", F.lit(True).alias("_known"))
    return left.join(known, "charge_type", "left").select(
        *LINE, "period", "amount", "currency",
        F.when(F.col("_known"), F.concat(F.lit("no usable allocation basis for "), "charge_type"))
        .otherwise(F.concat(F.lit("unknown charge type "), "charge_type")).alias("reason"))


# ---- profit and loss ----------------------------------------------------
@query("mart_pnl_revenue")
def mart_pnl_revenue(cat: Catalog) -> DataFrame:
    """Settlement lines in KRW; an unknown rate leaves the amounts unknown."""
    lines = cat["fact_settlement"].join(
        cat["fact_exchange_rate"].select("period", "currency", "rate_to_krw"), ["period", "currency"], "left")
    if "dim_channel_store" in cat and "country" in cat["dim_channel_store"].columns:
        lines = lines.join(cat["dim_channel_store"].select("channel_store_id", "country"), "channel_store_id", "left")
        country = F.coalesce("country", F.lit("KR"))
    else:
        country = F.lit("KR")
    rate = F.when(F.col("currency") == "KRW", F.lit(1.0)).otherwise(F.col("rate_to_krw"))

    def krw(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0)) * F.col("_rate")

    return lines.withColumn("_rate", rate).select(
        *GRAIN, country.alias("country"),
        krw("gross_sales").alias("gross_sales_krw"), krw("discounts").alias("discounts_krw"),
        krw("refunds").alias("refunds_krw"), krw("net_payout").alias("net_revenue_krw"),
        F.lit("settlement").alias("source"),
        F.when(F.col("_rate").isNotNull(), "ACTUAL").otherwise("PARTIAL").alias("coverage_flag"))


@query("mart_pnl_cogs")
def mart_pnl_cogs(cat: Catalog) -> DataFrame:
    shipped = cat["fact_shipment"].filter("channel_order_id IS NOT NULL").groupBy(
        month("ship_date").alias("period"), "item_id",
        F.coalesce("channel_store_id", F.lit("UNKNOWN")).alias("channel_store_id"),
    ).agg(exact_sum("qty_shipped").alias("qty_shipped"))
    sold_back = cat["fact_return"].filter("channel_order_id IS NOT NULL").withColumn("period", month("return_date"))
    keys = ["period", "item_id"]
    if cat.policy.returns_by_store:
        stores = cat["fact_order"].groupBy("channel_order_id").agg(F.min("channel_store_id").alias("channel_store_id"))
        sold_back = sold_back.join(stores, "channel_order_id", "left").withColumn(
            "channel_store_id", F.coalesce("channel_store_id", F.lit("UNKNOWN")))
        keys = GRAIN
    returned = sold_back.groupBy(*keys).agg(exact_sum("qty_returned").alias("qty_returned"))
    net = shipped.join(returned, keys, "left").withColumn(
        "qty_returned", F.coalesce("qty_returned", F.lit(0.0))).withColumns({
            "qty_net": F.col("qty_shipped") - F.col("qty_returned"),
            "_month_end": F.last_day(F.concat("period", F.lit("-01")).cast("date")),
        })
    df = asof_join(net, cat["unit_cost"], ["item_id"], "_month_end", "effective_from", ["unit_cost_krw"])
    return df.select(
        *GRAIN, F.lit("KR").alias("country"), "qty_shipped", "qty_returned", "qty_net", "unit_cost_krw",
        (F.col("qty_net") * F.col("unit_cost_krw")).alias("cogs_krw"),
        F.when(F.col("unit_cost_krw").isNotNull(), "ACTUAL").otherwise("PARTIAL").alias("coverage_flag"))


@query("mart_pnl_gross_margin")
def mart_pnl_gross_margin(cat: Catalog) -> DataFrame:
    revenue = cat["mart_pnl_revenue"].groupBy(*FULL_GRAIN).agg(
        exact_sum("net_revenue_krw").alias("_rev"), flag_of_rows("coverage_flag").alias("_rev_flag"))
    cogs = cat["mart_pnl_cogs"].select(
        *GRAIN, F.col("country").alias("_c_country"), F.col("cogs_krw").alias("_cogs"),
        F.col("coverage_flag").alias("_cogs_flag"))
    zero = F.lit(0.0)
    df = revenue.join(cogs, GRAIN, "full").select(
        *GRAIN, F.coalesce("country", "_c_country", F.lit("KR")).alias("country"),
        F.coalesce("_rev", zero).alias("net_revenue_krw"), F.coalesce("_cogs", zero).alias("cogs_krw"),
        worst_flag(F.col("_rev_flag"), F.col("_cogs_flag")).alias("coverage_flag"),
    ).withColumn("gross_margin_krw", F.col("net_revenue_krw") - F.col("cogs_krw"))
    pct = F.when(F.col("net_revenue_krw") != 0, F.col("gross_margin_krw") / F.col("net_revenue_krw")).otherwise(zero)
    return df.select(
        *FULL_GRAIN, "net_revenue_krw", "cogs_krw", "gross_margin_krw", pct.alias("gross_margin_pct"), "coverage_flag")


@query("mart_pnl_variable_cost")
def mart_pnl_variable_cost(cat: Catalog) -> DataFrame:
    """Summed from classes, so no shipment row is expanded.

    Written once: contribution, profit, waterfall and ranking all read it, and
    it is far smaller than the allocation behind it.
    """
    def krw(units: Column) -> Column:
        return (_unit(cat, units) * F.col("rate")).cast(MONEY)

    spent = krw(F.col("q")) * (F.col("n") - F.col("m")) + krw(F.col("q") + 1) * F.col("m")
    summed = cat["allocated_classes"].groupBy(
        "period", F.coalesce("item_id", F.lit("ALL")).alias("item_id"),
        F.coalesce("channel_store_id", F.lit("ALL")).alias("channel_store_id"), "charge_domain", "charge_type",
    ).agg(F.sum(spent).cast("double").alias("allocated_amount_krw")).select(
        *GRAIN, F.lit("KR").alias("country"), "charge_domain", "charge_type", "allocated_amount_krw",
        F.lit("ACTUAL").alias("coverage_flag"))
    return materialize(summed, "variable-cost")


@query("mart_pnl_contribution")
def mart_pnl_contribution(cat: Catalog) -> DataFrame:
    cost = cat["mart_pnl_variable_cost"].groupBy(*GRAIN).agg(exact_sum("allocated_amount_krw").alias("_vc"))
    vc = F.coalesce("_vc", F.lit(0.0))
    left = F.col("gross_margin_krw") - vc
    pct = F.when(F.col("net_revenue_krw") != 0, left / F.col("net_revenue_krw")).otherwise(F.lit(0.0))
    return cat["mart_pnl_gross_margin"].join(cost, GRAIN, "left").select(
        *FULL_GRAIN, "gross_margin_krw", vc.alias("total_variable_cost_krw"), left.alias("contribution_krw"),
        pct.alias("contribution_pct"), worst_flag(F.col("coverage_flag")).alias("coverage_flag"))


@query("mart_pnl_operating_profit")
def mart_pnl_operating_profit(cat: Catalog) -> DataFrame:
    return cat["mart_pnl_contribution"].select(
        *FULL_GRAIN, "contribution_krw", F.lit(0.0).alias("fixed_cost_krw"),
        F.col("contribution_krw").alias("operating_profit_krw"),
        F.col("contribution_pct").alias("operating_profit_pct"), worst_flag(F.col("coverage_flag")).alias("coverage_flag"))


# step: (mart, measure, label), in report order
WATERFALL = [
    ("mart_pnl_revenue", "net_revenue_krw", "매출 (Net Revenue)"),
    ("mart_pnl_cogs", "cogs_krw", "매출원가 (COGS)"),
    ("mart_pnl_gross_margin", "gross_margin_krw", "매출총이익 (Gross Margin)"),
    ("mart_pnl_variable_cost", "allocated_amount_krw", "변동비 (Variable Cost)"),
    ("mart_pnl_contribution", "contribution_krw", "공헌이익 (Contribution)"),
    ("mart_pnl_operating_profit", "operating_profit_krw", "영업이익 (Operating Profit)"),
]


@query("mart_pnl_waterfall")
def mart_pnl_waterfall(cat: Catalog) -> DataFrame:
    out = None
    for order, (mart, measure, label) in enumerate(WATERFALL, start=1):
        step = cat[mart].groupBy("period").agg(F.coalesce(exact_sum(measure), F.lit(0.0)).alias("amount_krw")).select(
            "period", F.lit(label).alias("metric_name"), F.lit(order).alias("metric_order"), "amount_krw")
        out = step if out is None else out.unionByName(step)
    return out


@query("versioned_join")
def versioned_join(cat: Catalog) -> DataFrame:
    """Order lines with the unit cost in force on the order date; lines before any version drop out."""
    lines = cat["fact_order"].select("channel_order_id", "line_no", "item_id", "order_date", "qty_ordered")
    return asof_join(
        lines, cat["unit_cost"], ["item_id"], "order_date", "effective_from", ["unit_cost_krw"], how="inner")


@query("profitability_ranking")
def profitability_ranking(cat: Catalog) -> DataFrame:
    revenue = cat["mart_pnl_revenue"].groupBy(*FULL_GRAIN).agg(
        exact_sum("net_revenue_krw").alias("net_revenue_krw"), flag_of_rows("coverage_flag").alias("_r"))
    margin = cat["mart_pnl_gross_margin"].select(
        *FULL_GRAIN, "gross_margin_krw", "gross_margin_pct", F.col("coverage_flag").alias("_g"))
    contribution = cat["mart_pnl_contribution"].select(
        *FULL_GRAIN, "contribution_krw", "contribution_pct", F.col("coverage_flag").alias("_c"))
    df = revenue.join(margin, FULL_GRAIN, "left").join(contribution, FULL_GRAIN, "left")
    score = F.coalesce("contribution_krw", "gross_margin_krw", "net_revenue_krw")
    df = row_number_in_steps(
        df.withColumn("_step", falling_bucket(score)), ["period"], ["_step"],
        [F.desc_nulls_first(score), "item_id", "channel_store_id", "country"], "rank_by_contribution")
    return df.select(
        *FULL_GRAIN, "net_revenue_krw", "gross_margin_krw", "gross_margin_pct", "contribution_krw",
        "contribution_pct", "rank_by_contribution",
        worst_flag(F.col("_r"), F.col("_g"), F.col("_c")).alias("coverage_flag"))


PNL_MARTS = ["revenue", "cogs", "gross_margin", "variable_cost", "contribution", "operating_profit"]


@query("pnl_coverage_rows")
def pnl_coverage_rows(cat: Catalog) -> DataFrame:
    out = None
    for mart in PNL_MARTS:
        counts = cat[f"mart_pnl_{mart}"].groupBy("period").agg(
            F.count_if(F.col("coverage_flag") == "ACTUAL").alias("actual_count"),
            F.count_if(F.col("coverage_flag") == "PARTIAL").alias("partial_count"),
            F.count(F.lit(1)).alias("total_count"),
        ).withColumn("mart", F.lit(mart))
        out = counts if out is None else out.unionByName(counts)
    return out.withColumn("actual_ratio", F.col("actual_count") / F.col("total_count"))
