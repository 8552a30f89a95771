"""Trailing mean and standard deviation per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY, MONEY_UNITS, money_units
from ledgerloom.policy import Policy


def severity(sigma: Column, policy: Policy) -> Column:
    out: Column | None = None
    for limit, level in policy.anomaly_levels:
        out = F.when(sigma >= limit, level) if out is None else out.when(sigma >= limit, level)
    return out.otherwise("LOW")


def detect(df: DataFrame, at: str, value: str, entity: list[str], metric: str, entity_type: str,
           policy: Policy) -> DataFrame:
    """Rows whose value lies two or more sigmas from the trailing mean.

    ``df`` holds one row per entity and ``at``, so a window partition is as
    long as the calendar. Sums and squares are fixed point (values below
    1e14), so the result does not depend on evaluation order. They are counted
    in 64-bit units where a whole window of such values fits, and as decimals
    in windows that hold a larger value.
    """
    w = Window.partitionBy(*entity).orderBy(at).rowsBetween(-(policy.anomaly_window - 1), 0)
    # n * sum of squares stays below 2^62 for values below the bound.
    bound = 1 << ((62 - 2 * policy.anomaly_window.bit_length()) // 2)
    u, exact = F.col("_u"), F.col(value).cast(MONEY)
    small = F.abs(u) < bound
    df = df.withColumn("_u", money_units(value)).withColumns({
        "_x": F.when(F.abs(u) <= 1 << 53, u.cast("double") / MONEY_UNITS).otherwise(exact.cast("double")),
        "_few": F.when(small, u), "_many": F.when(~small, exact)})
    few, many = F.col("_few"), F.col("_many")
    df = df.withColumns({
        "_n": F.count(u).over(w), "_s": F.sum(few).over(w), "_ss": F.sum(few * few).over(w),
        "_sm": F.sum(many).over(w), "_ssm": F.sum(many * many).over(w)}).filter(F.col("_n") >= policy.anomaly_min_points)
    unit, zero, plain = F.lit("0.0001").cast("decimal(4,4)"), F.lit(0), F.col("_sm").isNull()
    s = (F.coalesce(F.col("_s").cast("decimal(20,0)"), zero) * unit + F.coalesce("_sm", zero)).cast(MONEY)
    ss = (F.coalesce(F.col("_ss").cast("decimal(20,0)"), zero) * unit * unit
          + F.coalesce(F.col("_ssm").cast("decimal(35,8)"), zero)).cast("decimal(35,8)")
    spread = ss * F.col("_n").cast("decimal(2,0)") - s * s
    # The difference of the decimals is rounded to seven places; so is that of the units.
    units = F.expr("(_ss * _n - _s * _s + 5) div 10")
    n = F.col("_n").cast("double")
    df = df.withColumns({
        "_mean": F.when(plain, F.col("_s").cast("double") / MONEY_UNITS).otherwise(s.cast("double")) / n,
        "_spread": F.when(plain & (units <= 1 << 53), units.cast("double") / 1e7).otherwise(spread.cast("double")),
    }).withColumn("_std", F.sqrt(F.col("_spread") / (n * (n - 1)))).filter("_std > 0").withColumn(
        "deviation", (F.col("_x") - F.col("_mean")) / F.col("_std"))
    sigma = F.abs("deviation")
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in entity])
    return df.filter(sigma >= policy.anomaly_levels[-1][0]).select(
        F.lit(metric).alias("metric_name"), F.lit(entity_type).alias("entity_type"), name.alias("entity_id"),
        F.substring(F.col(at).cast("string"), 1, 7).alias("period"),
        F.col("_x").alias("current_value"), F.col("_mean").alias("expected_value"), "deviation",
        severity(sigma, policy).alias("severity"))
