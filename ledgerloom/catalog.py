"""Names to DataFrames.

A builder is a function of a catalog that returns a DataFrame; it asks the
catalog for the tables it needs by name. Nothing runs until an action, so
looking a name up only extends a logical plan. A pipeline run overrides names
with the tables it has already written, which cuts the lineage.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.policy import Policy
from ledgerloom.session import tune

Builder = Callable[["Catalog"], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_QUERIES: list[str] = []

_MODULES = [
    "ledgerloom.sources.canonical",
    "ledgerloom.sources.uploads",
    "ledgerloom.plans.scm",
    "ledgerloom.plans.pnl",
    "ledgerloom.plans.reco",
    "ledgerloom.plans.constraint",
    "ledgerloom.plans.coverage",
    "ledgerloom.plans.anomaly",
    "ledgerloom.plans.ingest",
    "ledgerloom.plans.rollback",
    "ledgerloom.plans.quality",
    "ledgerloom.plans.dashboards",
    "ledgerloom.plans.planning",
]


def table(name: str) -> Callable[[Builder], Builder]:
    """Register a builder for an input table."""

    def register(fn: Builder) -> Builder:
        _BUILDERS[name] = fn
        return fn

    return register


def query(name: str) -> Callable[[Builder], Builder]:
    """Register a builder and list it among the public queries."""

    def register(fn: Builder) -> Builder:
        _BUILDERS[name] = fn
        _QUERIES.append(name)
        return fn

    return register


def load_builders() -> dict[str, Builder]:
    for module in _MODULES:
        importlib.import_module(module)
    return _BUILDERS


def query_names() -> list[str]:
    load_builders()
    return list(_QUERIES)


class Catalog:
    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame] | None = None,
        policy: Policy | None = None,
        source_dir: str | None = None,
    ) -> None:
        self.spark = tune(spark)
        self.policy = policy or Policy()
        self.source_dir = source_dir
        # Plans that several builders share, beside the frames themselves.
        self.notes: dict[str, object] = {}
        self._frames: dict[str, DataFrame] = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            builders = load_builders()
            if name not in builders:
                raise KeyError(f"no table or builder named {name!r}")
            self._frames[name] = builders[name](self)
        return self._frames[name]

    def __setitem__(self, name: str, frame: DataFrame) -> None:
        self._frames[name] = frame

    def __contains__(self, name: str) -> bool:
        return name in self._frames or name in load_builders()

    def known(self, name: str) -> bool:
        """Whether a table was given or asked for before."""
        return name in self._frames

    def source(self, name: str) -> DataFrame:
        """One of the raw parquet tables under ``source_dir``."""
        if self.source_dir is None:
            raise KeyError(f"catalog has no source_dir, so no raw table {name!r}")
        return self.spark.read.parquet(f"{self.source_dir.rstrip('/')}/{name}.parquet")
