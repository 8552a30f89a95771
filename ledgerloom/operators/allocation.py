"""Spreading charges over shipments so that the parts add up to the invoice.

Shipments that share warehouse, store, item, lot and measures receive the same
floor and the same remainder, so they are collapsed to one *class* with a row
count before any charge is joined. All arithmetic is on integers: a basis value
and an amount are counted in 1/10000 units, a share is ``value * amount div
total`` and its remainder is exact.

The unit shortfall of a charge goes to the largest remainders. Ranking a charge
line in one window would put every shipment into one task, so the cut-off row
is found by narrowing: count rows per remainder bucket, then inside the bucket
that crosses the shortfall per exact remainder, warehouse and store, then per
item, then per class. Each count is a partial aggregation and each ordered
frame is small. The last pass compares every class with the cut-off. Every
round reads the same written classes and writes one row per charge line. When
the widest line was counted and is small, one window does the same in one pass.

Charges whose bases are storage bases are spread over stock instead of shipments: each
warehouse, item and lot weighs its quantity times the days it lay there, a step function
over the snapshots. Its classes and charge lines meet in spans of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import exact_sum, lookup, money_units, month
from ledgerloom.policy import SENTINEL, Policy
from ledgerloom.session import join_side, materialize

LINE = ["invoice_no", "invoice_line_no", "charge_type"]
UNITS = 10_000
BUCKETS = 65_536
# Joins against the classes use this many salts per warehouse, so one hot
# warehouse never lands in one task. Only the charge side is repeated.
SALTS = 8
# Up to this many scoped lines (about 200 bytes each) are broadcast.
BROADCAST_LINES = 100_000
# A line over at most this many classes is ordered in one window.
WINDOW_CLASSES = 500_000
# Identical rows of one class are written in pieces of this size.
PIECE = 100_000

_MEASURES = ["qty", "weight", "volume_cbm"]
# basis: measure it reads, or None where every shipment counts once
_BASIS_MEASURE = {
    "qty": "qty", "value": "qty", "weight": "weight", "volume_cbm": "volume_cbm",
    "revenue": None, "order_count": None, "line_count": None,
    "onhand_cbm_days": "volume_cbm", "onhand_qty_days": "qty",
}
STORAGE_BASES = ("onhand_cbm_days", "onhand_qty_days")
_STORAGE = "storage "


def target_classes(shipments: DataFrame, policy: Policy, snapshots: DataFrame | None = None) -> DataFrame:
    """Distinct shipment classes with their row count, and the classes of stock."""
    span = F.lit("") if policy.allocation_scope == "all" else month("ship_date")
    classes = shipments.groupBy(
        span.alias("_span"), "warehouse_id", "channel_store_id", "item_id", "lot_id",
        F.col("qty_shipped").alias("qty"), "weight", "volume_cbm",
    ).agg(F.count(F.lit(1)).alias("n"))
    if snapshots is not None:
        classes = classes.unionByName(storage_classes(snapshots, shipments, policy))
    return classes.withColumns({
        "_wh": F.coalesce("warehouse_id", F.lit("")),
        **{f"u_{m}": F.coalesce(money_units(m), F.lit(0).cast("bigint")) for m in _MEASURES},
        "_salt": F.pmod(F.hash("item_id", "channel_store_id", "lot_id", "qty"), F.lit(SALTS)),
    })


def stock_days(snapshots: DataFrame) -> DataFrame:
    """(period, warehouse_id, item_id, lot_id, qty_days): quantity on hand integrated over the days of each month.

    A snapshot holds until the next one of its warehouse, and the last one to the end of its
    month; a lot that a later snapshot does not list is gone by then. What runs over a month's
    end counts in both months. Negative stock counts as none. Only the days a warehouse was
    counted on are put in order, not the rows.
    """
    days = snapshots.filter("snapshot_date IS NOT NULL").select("warehouse_id", "snapshot_date").distinct()
    following = F.lead("snapshot_date").over(Window.partitionBy("warehouse_id").orderBy("snapshot_date"))
    spans = days.withColumn("_until", F.coalesce(following, F.add_months(F.trunc("snapshot_date", "month"), 1)))
    months = F.sequence(F.trunc("snapshot_date", "month"), F.trunc(F.date_sub("_until", 1), "month"), F.expr("interval 1 month"))
    spans = spans.withColumn("_m", F.explode(months))
    held = F.datediff(F.least("_until", F.add_months("_m", 1)), F.greatest("snapshot_date", "_m"))
    spans = spans.select(F.col("warehouse_id").alias("_w"), F.col("snapshot_date").alias("_d"), month("_m").alias("period"), held.alias("_days"))
    # Sent to the rows, if counted as few: by warehouse and day all items would meet in one task.
    spans = join_side(spans, "stock-spans")
    joined = snapshots.join(spans, F.col("warehouse_id").eqNullSafe(F.col("_w")) & (F.col("snapshot_date") == F.col("_d")))
    lain = F.greatest(F.col("onhand_qty"), F.lit(0.0)).cast("decimal(18,4)") * F.col("_days")
    return joined.groupBy("period", "warehouse_id", "item_id", "lot_id").agg(F.sum(lain).cast("double").alias("qty_days"))


def storage_classes(snapshots: DataFrame, shipments: DataFrame, policy: Policy) -> DataFrame:
    """Stock as allocation targets; an item's volume a unit is that of its shipments."""
    known = shipments.filter("volume_cbm IS NOT NULL AND qty_shipped > 0").groupBy(F.col("item_id").alias("_item")).agg(
        (exact_sum("volume_cbm") / exact_sum("qty_shipped")).alias("_unit"))
    stock = stock_days(snapshots)
    if policy.allocation_scope == "all":
        stock = stock.groupBy("warehouse_id", "item_id", "lot_id").agg(exact_sum("qty_days").alias("qty_days")).withColumn("period", F.lit(""))
    both = stock.join(known, F.col("item_id") == F.col("_item"), "left")
    return both.select(
        F.concat(F.lit(_STORAGE), "period").alias("_span"), "warehouse_id", F.lit(None).cast("string").alias("channel_store_id"), "item_id", "lot_id",
        F.col("qty_days").alias("qty"), F.lit(None).cast("double").alias("weight"), (F.col("qty_days") * F.col("_unit")).alias("volume_cbm"),
        F.lit(1).cast("bigint").alias("n"))


def is_storage(policy: Policy) -> Column:
    """Whether a charge line's first basis is a storage basis."""
    types = [t for t in policy.charge_types if policy.basis_priority(t)[:1] and policy.basis_priority(t)[0] in STORAGE_BASES]
    return F.coalesce(F.col("charge_type").isin(types), F.lit(False)) if types else F.lit(False)


def scope_totals(classes: DataFrame) -> DataFrame:
    """Per warehouse and basis: rows, total basis and whether any value is usable."""
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")]
    for m in _MEASURES:
        aggs.append(F.sum(F.col(f"u_{m}").cast("decimal(20,0)") * F.col("n")).alias(f"t_{m}"))
        aggs.append(F.bool_or(F.coalesce(F.col(m) != 0, F.lit(False))).alias(f"any_{m}"))
    wide = classes.groupBy("_span", "_wh").agg(*aggs)
    rows = [
        F.struct(
            F.lit(basis).alias("basis"),
            (F.col(f"t_{m}") if m else F.col("n").cast("decimal(20,0)") * UNITS).cast("decimal(28,0)").alias("total"),
            ((F.col(f"any_{m}") if m else F.lit(True)) & (F.col("_span").startswith(_STORAGE) == F.lit(basis in STORAGE_BASES))).alias("usable"),
        )
        for basis, m in _BASIS_MEASURE.items()
    ]
    return wide.select("_span", "_wh", "n", "classes", F.inline(F.array(*rows)))


def charge_scopes(charges: DataFrame, totals: DataFrame, policy: Policy) -> DataFrame:
    """The warehouses each charge line covers: its own if it has rows, else all."""
    span = F.lit("") if policy.allocation_scope == "all" else F.col("period")
    span = F.when(is_storage(policy), F.concat(F.lit(_STORAGE), span)).otherwise(span)
    lines = charges.select(*LINE, "warehouse_id", span.alias("_span"))
    homes = totals.select("_span", "_wh", "classes").distinct()
    marked = lines.join(
        homes.select("_span", F.col("_wh").alias("warehouse_id"), "classes"), ["_span", "warehouse_id"], "left")
    own = marked.filter("classes IS NOT NULL").select(*LINE, "_span", F.col("warehouse_id").alias("_wh"), "classes")
    everywhere = marked.filter("classes IS NULL").drop("classes").join(homes, "_span").select(
        *LINE, "_span", "_wh", "classes")
    return own.unionByName(everywhere)


def choose_basis(charges: DataFrame, scopes: DataFrame, totals: DataFrame, policy: Policy) -> DataFrame:
    """First basis in priority order with a non-zero value inside the scope.

    Lines over no shipment at all keep one stand-in target worth one unit.
    """
    spark = charges.sparkSession
    over = scopes.drop("classes").join(totals, ["_span", "_wh"]).groupBy(*LINE, "basis").agg(
        F.sum("total").cast("decimal(28,0)").alias("total"), F.sum("n").alias("targets"),
        F.bool_or("usable").alias("usable"))
    empty = charges.select(*LINE).join(scopes.select(*LINE).distinct(), LINE, "left_anti")
    stand_in = empty.select(
        *LINE,
        F.explode(F.array(*[F.lit(b) for b in _BASIS_MEASURE if b not in ("weight", "volume_cbm", *STORAGE_BASES)])).alias("basis"),
        F.lit(UNITS).cast("decimal(28,0)").alias("total"), F.lit(1).cast("bigint").alias("targets"),
        F.lit(True).alias("usable"))
    ranked = over.unionByName(stand_in).filter("usable").join(
        policy.basis_candidates(spark), ["charge_type", "basis"])
    best = ranked.groupBy(*LINE).agg(
        F.min_by(F.struct("basis", "total", "targets"), "priority").alias("_b"))
    return best.select(*LINE, "_b.basis", "_b.total", "_b.targets")


def _shares(
    lines: DataFrame, classes: DataFrame, few_lines: bool, same_class: Column | None = None,
) -> DataFrame:
    """Join lines to their classes and add floor ``q`` and remainder ``r``.

    A checked small number of lines is broadcast, so the classes never move.
    Otherwise both sides shuffle on warehouse and salt. ``same_class`` adds
    equalities between the two sides, named ``l`` and ``c``.
    """
    keys = ["_span", "_wh"]
    if few_lines:
        l = F.broadcast(lines.alias("l"))
    else:
        l = lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("l")
        keys.append("_salt")
    on = F.lit(True) if same_class is None else same_class
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"c.{k}"))
    df = l.join(classes.alias("c"), on).drop(*[F.col(f"l.{k}") for k in keys])
    v = F.when(F.col("_measure") == -1, F.lit(UNITS).cast("bigint"))
    for code, m in enumerate(_MEASURES):
        v = v.when(F.col("_measure") == code, F.col(f"u_{m}"))
    # 64-bit arithmetic wherever the product fits, 38 digits otherwise.
    fits = F.col("_den64").isNotNull() & (
        F.abs(F.col("v").cast("double") * F.col("_amount").cast("double")) < F.lit(9.0e18))
    wide = "CAST(v AS DECIMAL(18,0)) * CAST(_amount AS DECIMAL(18,0))"
    return (
        df.withColumn("v", v)
        .withColumn("r", F.when(fits, F.expr("CAST(pmod(v * _amount, _den64) AS DECIMAL(34,0))"))
                    .otherwise(F.expr(f"CAST(pmod({wide}, _den) AS DECIMAL(34,0))")))
        .withColumn("q", F.when(fits, F.expr("(v * _amount - pmod(v * _amount, _den64)) div _den64"))
                    .otherwise(F.expr(f"({wide} - r) div _den")))
    )


def _line_frame(charges: DataFrame, basis: DataFrame, policy: Policy) -> DataFrame:
    """Per charge line: integer amount, denominator and units to hand out.

    ``_measure`` is the position of the measure the basis reads, or -1 where
    every shipment counts once, which is also the rule for a zero total.
    """
    step = 10 ** (4 - policy.allocation_decimals)
    amount = F.col("amount").cast("decimal(18,4)")
    flat = F.col("total") == 0
    total = F.when(flat, F.col("targets").cast("decimal(28,0)") * UNITS).otherwise(F.col("total"))
    sign = F.when(total < 0, F.lit(-1)).otherwise(F.lit(1))
    den = (total * sign).cast("decimal(28,0)") * F.lit(step)
    code = {b: _MEASURES.index(m) if m else -1 for b, m in _BASIS_MEASURE.items()}
    return charges.select(*LINE, "amount").join(basis, LINE).select(
        F.monotonically_increasing_id().alias("_line"), *LINE, "basis",
        F.when(flat, F.lit(-1)).otherwise(lookup(F.col("basis"), code, -1)).alias("_measure"),
        (money_units("amount") * sign).alias("_amount"),
        den.cast("decimal(34,0)").alias("_den"), F.when(den < F.lit(9.0e18), den).cast("bigint").alias("_den64"),
        F.bround(amount * F.lit(10 ** policy.allocation_decimals), 0).cast("bigint").alias("units"),
    )


def _text_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _null_safe_number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(-1.0))


def _cross_over(groups: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """The group of each line in which the running count reaches ``_k``."""
    w = Window.partitionBy("_line").orderBy(*order)
    run = groups.withColumn("_upto", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_w") < F.col("_k"))).select(
        "_line", *keep, (F.col("_k") - F.col("_upto") + F.col("_w")).alias("_k"))


@dataclass(frozen=True)
class Plan:
    """Written inputs of one allocation run."""

    classes: DataFrame
    lines: DataFrame  # one row per charge line
    scoped: DataFrame  # lines repeated per warehouse they cover
    few_lines: bool  # the scoped lines were counted and may be broadcast
    largest: int  # classes under the widest line

    def units(self) -> DataFrame:
        floors = _shares(self.scoped, self.classes, self.few_lines).groupBy("_line").agg(_floor_units())
        return self.lines.join(floors, "_line").withColumn("shortfall", F.col("units") - F.col("floor_units"))


def _floor_units() -> Column:
    return F.sum(F.col("q").cast("decimal(20,0)") * F.col("n")).cast("bigint").alias("floor_units")


def _bucket() -> Column:
    share = F.col("r").cast("double") / F.col("_den").cast("double")
    return F.floor(share * BUCKETS).cast("int")


def plan_basis(
    charges: DataFrame, shipments: DataFrame, policy: Policy, snapshots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written classes, charge scopes, and the lazily chosen basis per line."""
    classes = materialize(target_classes(shipments, policy, snapshots), "classes")
    totals = materialize(scope_totals(classes), "totals")
    scopes = charge_scopes(charges, totals, policy)
    return classes, scopes, choose_basis(charges, scopes, totals, policy)


def plan_allocation(charges: DataFrame, shipments: DataFrame, policy: Policy, snapshots: DataFrame | None = None) -> Plan:
    """``charges`` is read several times, so it should be a written table."""
    classes, scopes, basis = plan_basis(charges, shipments, policy, snapshots)
    lines = materialize(_line_frame(charges, basis, policy), "lines")
    scoped = materialize(scopes.join(lines, LINE).select(
        "_line", "_span", "_wh", "classes", "_measure", "_amount", "_den", "_den64"), "scoped")
    size = scoped.groupBy("_line").agg(F.count(F.lit(1)).alias("_p"), F.sum("classes").alias("_c")).agg(
        F.sum("_p").alias("pairs"), F.max("_c").alias("largest")).first()
    return Plan(classes, lines, scoped.drop("classes"), (size.pairs or 0) <= BROADCAST_LINES, size.largest or 0)


_TAIL = ["_at_lot", "_at_v", "_at_qty", "_at_weight", "_at_volume"]


def _tail() -> list[Column]:
    return [_text_key("lot_id"), F.col("v"), *[_null_safe_number(c) for c in _MEASURES]]


def cut_off(plan: Plan) -> DataFrame:
    """Per line with a shortfall, the class in which the last extra unit falls."""
    buckets = materialize(
        _shares(plan.scoped, plan.classes, plan.few_lines).groupBy("_line", _bucket().alias("_bucket")).agg(
            F.sum("n").alias("_w"), _floor_units()), "buckets")
    floors = buckets.groupBy("_line").agg(F.sum("floor_units").alias("_f"))
    need = plan.lines.join(floors, "_line").select("_line", (F.col("units") - F.col("_f")).alias("_k")).filter("_k > 0")
    at = _cross_over(buckets.select("_line", "_bucket", "_w").join(need, "_line"), [F.desc("_bucket")], ["_bucket"])

    def narrow(at: DataFrame, inside: Column, same_class: Column | None, groups: dict[str, Column], order: list[Column],
               carry: list[str], label: str) -> DataFrame:
        found = _shares(plan.scoped.join(at, "_line"), plan.classes, plan.few_lines, same_class).filter(inside)
        counts = found.groupBy("_line", "_k", *carry, *[c.alias(k) for k, c in groups.items()]).agg(
            F.sum("n").alias("_w"))
        return materialize(_cross_over(counts, order, [*carry, *groups]), label)

    at = narrow(
        at, _bucket() == F.col("_bucket"), None,
        {"_r": F.col("r"), "_at_wh": F.col("_wh"), "_at_store": _text_key("channel_store_id")},
        [F.desc("_r"), F.asc("_at_wh"), F.asc("_at_store")], [], "cut-store")
    tied = F.col("r") == F.col("_r")
    here = (F.col("l._at_wh") == F.col("c._wh")) & (
        F.col("l._at_store") == F.coalesce(F.col("c.channel_store_id"), F.lit("")))
    at = narrow(at, tied, here, {"_at_item": _text_key("item_id")}, [F.asc("_at_item")],
                ["_r", "_at_wh", "_at_store"], "cut-item")
    here = here & (F.col("l._at_item") == F.coalesce(F.col("c.item_id"), F.lit("")))
    return narrow(at, tied, here, dict(zip(_TAIL, _tail())), [F.asc(k) for k in _TAIL],
                  ["_r", "_at_wh", "_at_store", "_at_item"], "cut-class")


def _extra_by_window(plan: Plan) -> DataFrame:
    """Extra units where every line is small enough to be ordered in one task."""
    line = Window.partitionBy("_line")
    upto = line.orderBy(
        F.desc("r"), "_wh", _text_key("channel_store_id"), _text_key("item_id"), *_tail(),
    ).rowsBetween(Window.unboundedPreceding, 0)
    floors = F.sum(F.col("q").cast("decimal(20,0)") * F.col("n")).over(line).cast("bigint")
    df = _shares(plan.scoped, plan.classes, plan.few_lines).withColumns(
        {"_floors": floors, "_upto": F.sum("n").over(upto)}).join(plan.lines.select("_line", *LINE, "basis", "units"), "_line")
    room = F.col("units") - F.col("_floors") - F.col("_upto") + F.col("n")
    return df.withColumn("m", F.greatest(F.lit(0), F.least(room, F.col("n"))).cast("bigint"))


def _extra_by_cut_off(plan: Plan) -> DataFrame:
    """Extra units by comparing each class with its line's cut-off; no line is gathered."""
    df = _shares(plan.scoped.join(cut_off(plan), "_line", "left"), plan.classes, plan.few_lines)
    mine = F.struct(F.col("_wh"), _text_key("channel_store_id"), _text_key("item_id"), *_tail())
    cut = F.struct(F.col("_at_wh"), F.col("_at_store"), F.col("_at_item"), *[F.col(k) for k in _TAIL])
    tied = F.when(mine < cut, F.col("n")).when(mine == cut, F.col("_k")).otherwise(F.lit(0))
    extra = (
        F.when(F.col("_k").isNull(), F.lit(0)).when(F.col("r") > F.col("_r"), F.col("n"))
        .when(F.col("r") == F.col("_r"), tied).otherwise(F.lit(0)).cast("bigint")
    )
    return df.withColumn("m", extra).join(plan.lines.select("_line", *LINE, "basis"), "_line")


def allocated_classes(plan: Plan, charges: DataFrame) -> DataFrame:
    """One row per charge line and class: floor ``q``, rows ``n``, rows with one more unit ``m``."""
    df = _extra_by_window(plan) if plan.largest <= WINDOW_CLASSES else _extra_by_cut_off(plan)
    placed = df.select(
        *LINE, "basis", "warehouse_id", "channel_store_id", "item_id", "lot_id",
        (F.col("v").cast("double") / UNITS).alias("basis_value"), "q", "n", "m")

    alone = plan.lines.join(plan.scoped, "_line", "left_anti").join(
        charges.select(*LINE, "warehouse_id", "channel_store_id"), LINE)
    stand_in = alone.select(
        *LINE, "basis",
        F.coalesce("warehouse_id", F.lit("UNKNOWN")).alias("warehouse_id"),
        F.coalesce("channel_store_id", F.lit("UNKNOWN")).alias("channel_store_id"),
        F.lit("UNALLOCATED").alias("item_id"), F.lit(SENTINEL).alias("lot_id"),
        F.lit(1.0).alias("basis_value"), F.col("units").alias("q"),
        F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))
    return placed.unionByName(stand_in)


def repeat_rows(df: DataFrame, count: str) -> DataFrame:
    """Emit each row ``count`` times; very large counts are cut up and spread first."""
    light = df.filter(f"{count} > 0 AND {count} <= {PIECE}")
    heavy = df.filter(f"{count} > {PIECE}").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({count} - 1) div {PIECE}"))))
    heavy = heavy.withColumn(
        count, F.least(F.lit(PIECE).cast("bigint"), F.col(count) - F.col("_piece") * PIECE),
    ).repartition("_piece").drop("_piece")
    both = light.unionByName(heavy)
    return both.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count)))).drop("_i", count)
