"""One alert per signal in a window: each alert that is kept silences those that follow it for the window's length.

Which alerts are kept is a chain, each link depending on the one before, and no window frame
states it. Time is cut into pieces as long as the window. A piece keeps one alert of a signal
at most: the first that is not silenced by what the piece before it kept. Whatever was kept
earlier no longer matters. So the pieces of a signal form runs without a gap, all runs of all
signals are worked on side by side, and a round keeps the alerts of one more piece of each:
a minimum over the piece's rows, pre-aggregated before the shuffle, joined with one row a signal.
A hot signal is read piece by piece and never gathered. There are as many rounds as the longest
run has pieces.

NULL parts of a signal are values. Alerts without a time are left out. Of alerts at the same
time the smallest id is the one that counts. An empty frame gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize, scratch_dir

DAY = 24 * 3600


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def suppress(alerts: DataFrame, signal: list[str], at: str, alert_id: str, seconds: int = DAY) -> DataFrame:
    """(signal columns, ``alert_id``, ``at``, signals): the kept alerts, and how many each stands for, itself included."""
    spark, wide = alerts.sparkSession, seconds * 1_000_000
    kind = alerts.schema[at].dataType.simpleString()
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = alerts.select(F.struct(*signal).alias("key"), micros.alias("us"), F.col(alert_id).alias("id")).filter("us IS NOT NULL")
    rows = rows.withColumn("piece", F.expr(f"cast(floor(us / {wide}L) as bigint)")).groupBy("key", "piece", "us").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "alerts")
    # Runs of pieces without a gap: only distinct pieces of a signal are put in order.
    pieces = rows.select("key", "piece").distinct()
    island = F.col("piece") - F.row_number().over(Window.partitionBy("key").orderBy("piece"))
    pieces = pieces.withColumn("_island", island).withColumn("_step", F.col("piece") - F.min("piece").over(Window.partitionBy("key", "_island")))
    pieces = pieces.select(F.col("key").alias("_k"), F.col("piece").alias("_p"), "_step")
    path = scratch_dir(spark, "alert-steps")
    placed = rows.join(pieces, _same("key", "_k") & _same("piece", "_p")).drop("_k", "_p")
    placed.write.partitionBy("_step").parquet(path)
    steps = spark.read.schema(placed.schema).parquet(path)
    last = steps.agg(F.max("_step")).first()[0]
    if last is None:
        return alerts.select(*signal, alert_id, at, F.lit(0).cast("long").alias("signals")).limit(0)
    earliest = F.min(F.struct("us", "id")).alias("first")
    kept = [materialize(steps.filter("_step = 0").groupBy("key", "piece").agg(earliest), "kept")]
    for step in range(1, last + 1):
        before = kept[-1].select(F.col("key").alias("_k"), (F.col("piece") + 1).alias("_p"), F.col("first.us").alias("_us"))
        here = steps.filter(F.col("_step") == step).join(before, _same("key", "_k") & _same("piece", "_p"), "left")
        free = here.filter(F.col("_us").isNull() | (F.col("us") >= F.col("_us") + wide))
        kept.append(materialize(free.groupBy("key", "piece").agg(earliest), "kept"))
    every = kept[0]
    for part in kept[1:]:
        every = every.unionByName(part)
    own = every.select(F.col("key").alias("_k"), F.col("piece").alias("_p"), F.col("first").alias("_own"))
    prior = every.select(F.col("key").alias("_j"), (F.col("piece") + 1).alias("_q"), F.col("first").alias("_prior"))
    owned = rows.join(own, _same("key", "_k") & _same("piece", "_p"), "left").join(prior, _same("key", "_j") & _same("piece", "_q"), "left")
    owner = F.when(F.col("us") >= F.col("_own.us"), F.col("_own")).otherwise(F.col("_prior"))
    counted = owned.groupBy("key", owner.alias("owner")).agg(F.sum("n").alias("signals"))
    return counted.select("key.*", F.col("owner.id").alias(alert_id), F.timestamp_micros("owner.us").cast(kind).alias(at), "signals")
