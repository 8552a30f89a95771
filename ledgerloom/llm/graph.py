"""Connected components of links that are kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.steps import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Links are replaced by stars around the smallest known neighbour until nothing
    changes: first every id points its larger neighbours to its smallest one, then every
    id points its smaller neighbours and itself there. Both rounds keep what is connected,
    and the number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder, so nothing has to be recomputed after a loss.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs, before = materialize(pairs, "links"), None
    while True:
        sizes = pairs.agg(F.count("*"), F.sum(F.col("b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sizes == before:
            break
        before = sizes
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = materialize(small.filter("a <> b").distinct(), "links")
    roots = pairs.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(roots)
