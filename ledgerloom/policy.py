"""Business policy: thresholds, charge types, allocation bases, coverage rules.

Everything here is small and fixed by configuration, never by data volume.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.exprs import literal_table

SENTINEL = "__NONE__"

# ---- fixed values -------------------------------------------------------
BASES = [
    "qty", "weight", "volume_cbm", "value", "revenue",
    "order_count", "line_count", "onhand_cbm_days", "onhand_qty_days",
]

# charge type: (domain, cost stage, capitalizable, default basis, severity if missing)
CHARGE_TYPES = {
    "LAST_MILE_PARCEL": ("logistics_transport", "outbound", False, "order_count", "warn"),
    "DOMESTIC_TRUCKING": ("logistics_transport", "outbound", False, "weight", "warn"),
    "FREIGHT_INTL_SEA": ("logistics_transport", "inbound_landed", True, "weight", "warn"),
    "FREIGHT_INTL_AIR": ("logistics_transport", "inbound_landed", True, "weight", "warn"),
    "PORT_TERMINAL_FEE": ("logistics_transport", "inbound_landed", True, "value", "warn"),
    "FORWARDER_FEE": ("logistics_transport", "inbound_landed", True, "value", "warn"),
    "CUSTOMS_DUTY": ("customs", "inbound_landed", True, "value", "warn"),
    "CUSTOMS_VAT": ("customs", "inbound_landed", True, "value", "warn"),
    "BROKER_FEE": ("customs", "inbound_landed", True, "value", "warn"),
    "CARGO_INSURANCE": ("logistics_transport", "inbound_landed", True, "value", "warn"),
    "3PL_STORAGE_FEE": ("3pl_billing", "storage", False, "onhand_cbm_days", "warn"),
    "3PL_PICK_PACK_FEE": ("3pl_billing", "outbound", False, "line_count", "warn"),
    "3PL_HANDLING_FEE": ("3pl_billing", "outbound", False, "line_count", "warn"),
    "3PL_RETURN_PROCESSING_FEE": ("3pl_billing", "returns", False, "line_count", "warn"),
    "DISPOSAL_FEE": ("3pl_billing", "returns", False, "qty", "warn"),
    "PLATFORM_FEE": ("platform_fee", "period", False, "revenue", "warn"),
    "PG_FEE": ("platform_fee", "period", False, "revenue", "warn"),
    "MARKETING_SPEND": ("marketing", "period", False, "revenue", "warn"),
}

STAGE_BASES = {
    "inbound_landed": ["weight", "volume_cbm", "value", "qty"],
    "storage": ["onhand_cbm_days", "onhand_qty_days"],
    "outbound": ["order_count", "line_count", "weight", "qty"],
    "returns": ["line_count", "qty"],
    "period": ["revenue", "line_count"],
}

BASIS_OVERRIDES = {
    "3PL_STORAGE_FEE": ["onhand_cbm_days", "onhand_qty_days"],
    "LAST_MILE_PARCEL": ["order_count", "line_count"],
}

# domain: requirement in an open period
COVERAGE_DOMAINS = {
    "fx_rate": "REQUIRED",
    "revenue_settlement": "OPTIONAL",
    "logistics_transport": "OPTIONAL",
    "customs": "OPTIONAL",
    "3pl_billing": "OPTIONAL",
    "cost_structure": "OPTIONAL",
}

# domain: requirement once the period is closed
CLOSE_ENFORCEMENT = {
    "fx_rate": "REQUIRED",
    "logistics_transport": "REQUIRED",
    "cost_structure": "REQUIRED",
}

# metric: (root cause, contributing factors)
ROOT_CAUSES = {
    "late_po_ratio": ("Supplier delivery performance below target", "Late shipments, capacity constraints"),
    "supplier_delay_days": ("Supplier production delays", "Lead time variability, raw material shortage"),
    "backlog_ship_orders": ("Warehouse processing capacity exceeded", "Staffing shortage, space constraints"),
    "dwell_time_days": ("Port/customs clearance delays", "Documentation issues, inspection holds"),
    "return_rate_spike": ("Product quality or fulfillment errors", "Damaged goods, wrong items shipped"),
    "expired_value_at_risk": ("Inventory aging beyond shelf life", "Over-ordering, demand forecast error"),
}
DEFAULT_ROOT_CAUSE = ("Unknown root cause", "Requires investigation")

# metric: (action, priority, responsible)
ACTIONS = {
    "late_po_ratio": ("Escalate to procurement; evaluate alternate suppliers", "HIGH", "Procurement"),
    "supplier_delay_days": ("Negotiate expedited shipping; increase safety stock", "HIGH", "Supply Chain"),
    "backlog_ship_orders": ("Add temporary labor; prioritize by SLA", "CRITICAL", "Warehouse Ops"),
    "dwell_time_days": ("Pre-clear documentation; engage customs broker", "MEDIUM", "Logistics"),
    "return_rate_spike": ("Root cause analysis on returns; quality audit", "HIGH", "Quality/CS"),
    "expired_value_at_risk": ("Markdown/donation plan; adjust reorder parameters", "CRITICAL", "Planning"),
}
DEFAULT_ACTION = ("Investigate and develop mitigation plan", "MEDIUM", "Operations")
# ---- end of fixed values ------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """All tunables. ``as_of`` replaces "today", so a run is repeatable."""

    as_of: dt.date = dt.date(2002, 1, 1)

    doh_overstock: dict[str, int] = field(
        default_factory=lambda: {"RM": 120, "PM": 180, "WIP": 90, "FG": 90})
    doh_default: int = 90
    stockout_days: int = 7
    expiry_buckets: tuple[int, ...] = (0, 30, 60, 90, 180, 365)
    min_sellable_days: dict[str, int] = field(
        default_factory=lambda: {"RM": 30, "PM": 90, "FG": 60})
    min_sellable_default: int = 60
    on_time_days: int = 3
    reco_warn: float = 0.01
    reco_high: float = 0.03
    late_po_ratio: float = 0.2
    supplier_delay_days: float = 7.0
    backlog_orders: float = 200.0
    dwell_days: float = 5.0
    return_spike: float = 1.5
    default_eta_days: int = 14

    allocation_decimals: int = 0
    # Missing FX: revenue leaves the amount unknown, allocation and the
    # settlement reconciliation fall back to this rate.
    allocation_fx_default: float = 1.0
    # "all" spreads a charge over every shipment, "period" over its own month.
    allocation_scope: str = "period"
    # Returns reduce cost of goods per item; True attributes them by order.
    returns_by_store: bool = False

    amount_outlier: float = 100_000_000.0
    date_past_days: int = 3650
    date_future_days: int = 60

    anomaly_window: int = 14
    anomaly_min_points: int = 7
    # sigma: severity, strongest first
    anomaly_levels: tuple[tuple[float, str], ...] = ((3.0, "CRITICAL"), (2.5, "HIGH"), (2.0, "MEDIUM"))

    charge_types: dict = field(default_factory=lambda: dict(CHARGE_TYPES))
    stage_bases: dict = field(default_factory=lambda: dict(STAGE_BASES))
    basis_overrides: dict = field(default_factory=lambda: dict(BASIS_OVERRIDES))
    coverage_domains: dict = field(default_factory=lambda: dict(COVERAGE_DOMAINS))
    close_enforcement: dict = field(default_factory=lambda: dict(CLOSE_ENFORCEMENT))

    def basis_priority(self, charge_type: str) -> list[str]:
        if charge_type in self.basis_overrides:
            return self.basis_overrides[charge_type]
        _, stage, _, default, _ = self.charge_types[charge_type]
        return self.stage_bases.get(stage, [default])

    def problems(self) -> list[str]:
        """Bases and charge types the configuration names but does not support."""
        out = [f"{t}: unsupported basis {spec[3]}" for t, spec in self.charge_types.items() if spec[3] not in BASES]
        for where, table in (("stage", self.stage_bases), ("override", self.basis_overrides)):
            out += [f"{where} {k}: unsupported basis {b}" for k, bases in table.items() for b in bases if b not in BASES]
        out += [f"override for unknown charge type {t}" for t in self.basis_overrides if t not in self.charge_types]
        return out

    def charge_policy(self, spark: SparkSession) -> DataFrame:
        """The charge-type dimension, one row per configured type."""
        rows = [(name, *spec) for name, spec in self.charge_types.items()]
        return literal_table(
            spark,
            ["charge_type", "charge_domain", "cost_stage", "capitalizable_flag",
             "default_allocation_basis", "severity_if_missing"],
            rows,
        )

    def basis_candidates(self, spark: SparkSession) -> DataFrame:
        """One row per charge type and candidate basis, lower priority wins."""
        rows = [
            (name, basis, rank)
            for name in self.charge_types
            for rank, basis in enumerate(self.basis_priority(name))
        ]
        return literal_table(spark, ["charge_type", "basis", "priority"], rows)
