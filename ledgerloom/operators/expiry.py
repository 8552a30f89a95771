"""Lot expiry: final date, sellable split, FEFO order, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.functions.exprs import days_between, lookup
from ledgerloom.operators.ranking import row_number_in_steps
from ledgerloom.policy import Policy


#: Lots of one item whose dates of manufacture are kept in the item's row.
LOTS_IN_ROW = 1_000


def with_made(snapshot: DataFrame, items: DataFrame, made: DataFrame) -> DataFrame:
    """The snapshot with its items' columns and ``_mfg``, the date of manufacture of the lot.

    Beyond few items or lots, the lots go into the rows of their items first, so the snapshot meets
    them by item alone and one dealt out by item stays where it is. Items with very many lots are
    joined by lot.
    """
    if max(items.count(), made.count()) <= session.FEW:
        return snapshot.join(items, "item_id", "left").join(F.broadcast(made), ["item_id", "lot_id"], "left")
    long = made.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LOTS_IN_ROW)
    many = None if long.isEmpty() else made.join(long, "item_id", "left_semi").withColumnRenamed("_mfg", "_other")
    some = made if many is None else made.join(long, "item_id", "left_anti")
    lots = some.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("lot_id", "_mfg"))).alias("_lots"))
    df = snapshot.join(items.join(lots.hint("merge"), "item_id", "left").hint("shuffle_hash"), "item_id", "left")
    df = df.withColumn("_mfg", F.try_element_at("_lots", F.col("lot_id"))).drop("_lots")
    if many is None:
        return df
    return df.join(many.hint("merge"), ["item_id", "lot_id"], "left").withColumn("_mfg", F.coalesce("_mfg", "_other")).drop("_other")


def final_expiry(snapshot: DataFrame, items: DataFrame, receipts: DataFrame, policy: Policy) -> DataFrame:
    """Explicit expiry first, else manufacture date of the lot plus shelf life."""
    made = (
        receipts.filter("mfg_date IS NOT NULL AND lot_id IS NOT NULL")
        .groupBy("item_id", "lot_id").agg(F.min("mfg_date").alias("_mfg"))
    )
    items = items.select("item_id", "item_type", "min_sellable_days", "qc_required_flag", "shelf_life_days")
    df = with_made(snapshot, items, session.materialize(made.filter("item_id IS NOT NULL"), "lots-made"))
    by_shelf = F.when(F.col("shelf_life_days").isNotNull(), F.date_add("_mfg", F.col("shelf_life_days")))
    return df.withColumns({
        "final_expiry_date": F.coalesce("expiry_date", by_shelf),
        "effective_min_sellable_days": F.coalesce(
            "min_sellable_days",
            lookup(F.col("item_type"), policy.min_sellable_days, policy.min_sellable_default),
        ).cast("int"),
    }).drop("_mfg")


def sellable_split(df: DataFrame) -> DataFrame:
    """Add expired, blocked and sellable quantities."""
    expiry, day, onhand = F.col("final_expiry_date"), F.col("snapshot_date"), F.col("onhand_qty")
    expired = F.coalesce(expiry < day, F.lit(False))
    held = F.coalesce(F.col("hold_flag"), F.lit(False))
    qc_open = F.coalesce(F.col("qc_required_flag"), F.lit(False)) & (
        F.lower(F.coalesce("qc_status", F.lit(""))) != "released")
    short = F.coalesce(
        (expiry >= day) & (expiry < F.date_add(day, F.col("effective_min_sellable_days"))), F.lit(False))
    out = df.withColumns({
        "expired_qty": F.when(expired, onhand).otherwise(F.lit(0.0)),
        "blocked_qty": F.when(held | qc_open | short, onhand).otherwise(F.lit(0.0)),
    })
    return out.withColumn(
        "sellable_qty", F.greatest(onhand - F.col("expired_qty") - F.col("blocked_qty"), F.lit(0.0)))


FEFO_KEYS = ["warehouse_id", "item_id"]


def fefo_rank(df: DataFrame, large: DataFrame | None) -> DataFrame:
    """First expiring lot first within (warehouse, item); no date, no rank.

    One window numbers the rows, so they move once. Keys in ``large`` (see :func:`large_keys`)
    have more rows than a task should sort and are numbered in steps.
    """
    w = Window.partitionBy(*FEFO_KEYS).orderBy(F.asc_nulls_last("final_expiry_date"), "snapshot_date", "lot_id")
    rank = F.when(F.col("final_expiry_date").isNotNull(), F.row_number().over(w))
    if large is None:
        return df.withColumn("fefo_rank", rank)
    few = df.join(large, FEFO_KEYS, "left_anti").withColumn("fefo_rank", rank)
    many = df.join(large, FEFO_KEYS, "left_semi")
    dated = row_number_in_steps(
        many.filter("final_expiry_date IS NOT NULL"), FEFO_KEYS,
        coarse=["final_expiry_date", "snapshot_date"], fine=["lot_id"], out="fefo_rank")
    undated = many.filter("final_expiry_date IS NULL").withColumn("fefo_rank", F.lit(None).cast("int"))
    return few.unionByName(dated).unionByName(undated)


def bucket_label(days: Column, bounds: tuple[int, ...]) -> Column:
    out = F.when(days.isNull(), "N/A").when(days < 0, "EXPIRED")
    for low, high in zip(bounds, bounds[1:]):
        out = out.when(days < high, f"{low}-{high}d")
    return out.otherwise(f">{bounds[-1]}d")


def expiry_bucket(df: DataFrame, policy: Policy) -> DataFrame:
    days = days_between("final_expiry_date", "snapshot_date")
    return df.withColumn("days_to_expiry", days).withColumn(
        "expiry_bucket", bucket_label(F.col("days_to_expiry"), policy.expiry_buckets))
