"""Supply-chain and P&L analytics marts expressed as Spark DataFrames."""

from ledgerloom.catalog import Catalog
from ledgerloom.policy import Policy

__all__ = ["Catalog", "Policy"]
