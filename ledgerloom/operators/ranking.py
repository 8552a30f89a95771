"""Row numbers that stay distributed when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import join_side

#: Rows of one key that are numbered in one task.
WINDOW_ROWS = 1_000_000


def large_keys(df: DataFrame, partition: list[str]) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys with more than ``WINDOW_ROWS`` of them, or None."""
    counts = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.col("_n") > WINDOW_ROWS
    for k in partition:
        whole = whole & F.col(k).isNotNull()
    size = counts.agg(F.sum("_n").alias("rows"), F.bool_or(whole).alias("large")).first()
    # At most one key in ``WINDOW_ROWS`` rows is kept.
    return size.rows or 0, join_side(counts.filter(whole).drop("_n"), "large-keys") if size.large else None


def row_number_in_steps(
    df: DataFrame,
    partition: list[str],
    coarse: list[str],
    fine: list[Column | str],
    out: str,
) -> DataFrame:
    """``row_number() over (partition order by coarse, fine)`` in two steps.

    Rows are numbered inside (partition, coarse), then shifted by the number of
    rows in earlier coarse groups. Only group counts are ever ordered per
    partition key, so a hot key is spread over its coarse values.
    ``coarse`` columns order ascending and must not be NULL.
    """
    keys = partition + coarse
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys).orderBy(*fine)
    numbered = df.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("int"))
        .drop("_before", "_local")
    )


def running_sum_in_steps(
    df: DataFrame, partition: list[str], coarse: str, fine: list[Column | str], value: Column, out: str,
) -> DataFrame:
    """Running sum of a decimal ``value`` in (coarse, fine) order, in the same two steps."""
    keys = [*partition, coarse]
    df = df.withColumn("_v", value)
    totals = df.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*partition).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_local", F.sum("_v").over(local))
    return summed.join(offsets, keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_v", "_local", "_before")


def falling_bucket(score: Column) -> Column:
    """A coarse key that rises as ``score`` falls, about one per cent wide; NULL comes first."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(score)) * 64).cast("int")
    return F.coalesce(F.when(score >= 0, -size).otherwise(size), F.lit(-(2**31) + 1))
