"""Undoing the last batches: versioned facts go back, the log says so, marts are built again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, query
from ledgerloom.functions.exprs import exact_sum
from ledgerloom.operators import ingest
from ledgerloom.plans.ingest import last_batches
from ledgerloom.plans.pipeline import STEPS, Run, run_pipeline
from ledgerloom.policy import Policy
from ledgerloom.session import scratch_dir
from ledgerloom.sources import history
from ledgerloom.sources.canonical import share_lines
from ledgerloom.sources.contracts import CONTRACTS
from ledgerloom.sources.tables import exists

#: The measure of each fact that a rollback covers.
MEASURES = {
    "fact_order": "qty_ordered", "fact_shipment": "qty_shipped", "fact_return": "qty_returned", "fact_inventory_snapshot": "onhand_qty",
    "fact_po": "qty_ordered", "fact_receipt": "qty_received", "fact_settlement": "net_payout", "fact_charge_actual": "amount",
    "fact_exchange_rate": "rate_to_krw", "fact_cost_structure": "cost_per_unit_krw",
}
#: Tables that are worked on at the same time; each is a few Spark jobs of its own.
AT_ONCE = 4


def each_fact(spark, work: Callable[[str], object], names: list[str]) -> dict[str, object]:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(spark)(work), names)))


def rollback(
    spark, root: str, n: int, marts_dir: str | None = None, policy: Policy | None = None, dims: dict[str, DataFrame] | None = None,
    at: dt.datetime | None = None, steps: list[str] | None = None,
) -> tuple[list[int], Run | None]:
    """Undo the ``n`` batches of highest id in every fact under ``root`` and rebuild the marts.

    The log ``<root>/batch_log`` names the batches; they are marked rolled back. Marts are
    built from the facts as they are then, all but the anomaly signals; ``dims`` adds tables
    that have no batches. Facts that were never stored are left out.
    """
    gone = [r[0] for r in last_batches(history.batch_status(spark, f"{root}/batch_log"), n).collect()]
    stored = [f for f in MEASURES if exists(spark, f"{root}/{f}")]
    if gone:
        each_fact(spark, lambda f: history.undo_batches(spark, f, f"{root}/{f}", gone), stored)
        history.log_batch(spark, f"{root}/batch_log", gone, "rolled_back", at or dt.datetime.now())
    if marts_dir is None or not gone:
        return gone, None
    tables = {f: history.current(spark, f"{root}/{f}") for f in stored} | (dims or {})
    wanted = [s for s in steps or STEPS if s != "mart_anomaly_signals"]
    return gone, run_pipeline(Catalog(spark, tables, policy), marts_dir, wanted)


# ---- queries ------------------------------------------------------------
@query("rollback_batches")
def rollback_batches(cat: Catalog) -> DataFrame:
    """Shipments after three batches are undone: rows that those had replaced are back."""
    per_batch = ingest.promote(cat["upload_shipment"], "shipment", per_batch=True)
    path = scratch_dir(cat.spark, "versions")
    history.load_versions(per_batch, "fact_shipment", path)
    gone = [r[0] for r in last_batches(cat["batch_log"], 3).collect()]
    return history.undo_batches(cat.spark, "fact_shipment", path, gone).drop("volume_cbm", "channel_store_id")


@query("rollback_facts")
def rollback_facts(cat: Catalog) -> DataFrame:
    """The ten facts after a second batch was merged and undone: how many rows it held, and the state that is back."""
    root = scratch_dir(cat.spark, "warehouse")
    share_lines(cat)

    def there_and_back(fact: str) -> DataFrame:
        path, value = f"{root}/{fact}", MEASURES[fact]
        first = history.merge_batch(cat[fact], fact, path, 1)
        # About a third of the keys change their measure, by a hash that SQL has too.
        some = F.substring(F.md5(F.col(CONTRACTS[fact].key[0]).cast("string")), 1, 1) < "5"
        second = history.merge_batch(first.filter(some).withColumn(value, F.col(value) + 1000), fact, path, 2)
        # Counted here: the files read for it are replaced by what follows.
        merged = second.filter("load_batch_id = 2").count()
        back = history.undo_batches(cat.spark, fact, path, [2])
        return back.agg(F.count(F.lit(1)).alias("row_count"), exact_sum(value).alias("total"), F.max("load_batch_id").alias("last_batch")).select(
            F.lit(fact).alias("table_name"), F.lit(merged).cast("long").alias("merged_rows"), "row_count", "total", "last_batch")

    for name in MEASURES:
        cat[name]  # plans are made in one thread
    parts = each_fact(cat.spark, there_and_back, list(MEASURES))
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    return out
