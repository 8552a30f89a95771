"""As-of join: the latest version whose start date is not after the row's date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity(versions: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Add ``_until``, the start of the next version of the same key.

    ``versions`` must hold one row per key and start date.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    return versions.withColumn("_until", F.lead(start).over(w))


def asof_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: list[str],
    at: str,
    start: str,
    values: list[str],
    how: str = "left",
) -> DataFrame:
    """Join each fact to at most one version; no row is multiplied.

    Each version becomes an interval [start, next start), so the join is an
    equality on the key with a range residual. Nothing is ranked afterwards.
    """
    v = validity(versions.select(*keys, start, *values), keys, start).select(
        *[F.col(k).alias(f"_v_{k}") for k in keys], F.col(start).alias("_from"), "_until", *values)
    on = (F.col("_from") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_v_{k}"))
    return facts.join(v, on, how).drop("_from", "_until", *[f"_v_{k}" for k in keys])
