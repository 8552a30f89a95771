"""A full run: build the marts in dependency order and write each one once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog
from ledgerloom.sources.tables import write_mart

SCM = [
    "lots", "mart_inventory_onhand", "mart_open_po", "mart_stockout_risk", "mart_overstock", "mart_expiry_risk",
    "mart_fefo_pick_list", "mart_service_level", "mart_shipment_performance", "mart_shipment_daily",
    "mart_return_analysis", "mart_return_daily", "mart_inventory_turnover",
]
ALLOCATION = ["allocated_classes", "mart_charge_allocated", "unallocated_charges"]
PNL = [
    "mart_pnl_revenue", "mart_pnl_cogs", "mart_pnl_gross_margin", "mart_pnl_variable_cost", "mart_pnl_contribution",
    "mart_pnl_operating_profit", "mart_pnl_waterfall",
]
RECO = [
    "reco_inventory_movement", "reco_oms_vs_wms", "reco_erp_vs_wms_receipt", "reco_settlement_vs_estimated",
    "reco_charges_tieout",
]
CONSTRAINT = [
    "mart_constraint_signals", "mart_constraint_root_cause", "mart_constraint_action_plan", "constraint_issues",
    "expired_issues", "mart_constraint_effectiveness",
]
STEPS = [*SCM, *ALLOCATION, *PNL, *RECO, *CONSTRAINT, "mart_coverage_period", "mart_anomaly_signals"]

# A failed check here stops the run instead of being recorded.
GRAIN = {"mart_pnl_cogs": ["period", "item_id", "channel_store_id"]}
# Written as one sorted list; every other mart with a period is partitioned by it.
UNPARTITIONED = {"expired_issues", "constraint_issues", "allocated_classes"}


class DuplicateGrain(ValueError):
    pass


@dataclass
class Run:
    rows: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def run_pipeline(cat: Catalog, out_dir: str, steps: list[str] | None = None, dry_run: bool = False) -> Run:
    """Write every step under ``out_dir``; later steps read the written tables.

    A failing step is recorded and the rest goes on. A dry run only resolves
    the plans and writes nothing.
    """
    run = Run()
    for name in steps or STEPS:
        try:
            df = cat[name]
            if dry_run:
                run.rows[name] = len(df.columns)
                continue
            by_period = "period" in df.columns and name not in UNPARTITIONED
            written = write_mart(df, f"{out_dir.rstrip('/')}/{name}", "period" if by_period else None)
            cat[name] = written
            run.rows[name] = written.count()
        except DuplicateGrain:
            raise
        except Exception as exc:
            run.errors[name] = str(exc)
            continue
        if name in GRAIN:
            again = written.groupBy(*GRAIN[name]).count().filter(F.col("count") > 1)
            if not again.isEmpty():
                raise DuplicateGrain(f"{name} repeats its grain {GRAIN[name]}")
    return run
