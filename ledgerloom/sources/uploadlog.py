"""What was uploaded before: a stored log of content hashes, asked before anything is loaded.

An upload is known if the log has its content hash under the same table as loaded or as a
duplicate. A known one is logged as a duplicate and not loaded, unless it is forced. The log
is in one folder per batch, so a batch that is run again replaces its own entries and does
not find itself. Only log rows with a hash that is asked for pass the first join; the hashes
of a batch are one row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialize
from ledgerloom.sources.tables import exists

SCHEMA = "table_name string, content_hash string, source_file_name string, row_count long, status string, first_batch long, batch_id long"
_KEY = ["table_name", "content_hash"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def find_existing(hashes: DataFrame, log: DataFrame) -> DataFrame:
    """(table_name, content_hash, first_batch) of the hashes that the log knows."""
    known = log.filter(F.col("status").isin("success", "duplicate")).select(*_KEY, "batch_id")
    return known.join(hashes.select(*_KEY).distinct(), _KEY, "left_semi").groupBy(*_KEY).agg(F.min("batch_id").alias("first_batch"))


def admit(hashes: DataFrame, path: str, batch_id: int, force: bool = False) -> DataFrame:
    """Judge the files of a batch (table_name, content_hash, source_file_name, row_count) and log them.

    Of equal files within a batch the first name counts. ``force`` loads all of them.
    """
    spark = hashes.sparkSession
    log = read_log(spark, path).filter(F.col("batch_id") != batch_id)
    hashes = materialize(hashes.select(*_KEY, "source_file_name", "row_count"), "upload-hashes")
    first = hashes.groupBy(*_KEY).agg(F.min("source_file_name").alias("_first"))
    judged = hashes.join(first, _KEY).join(find_existing(hashes, log), _KEY, "left")
    again = F.col("first_batch").isNotNull() | (F.col("source_file_name") != F.col("_first"))
    duplicate = F.lit(False) if force else again
    judged = judged.select(
        *_KEY, "source_file_name", "row_count", F.when(duplicate, "duplicate").otherwise("success").alias("status"),
        F.when(duplicate, F.coalesce("first_batch", F.lit(batch_id).cast("long"))).alias("first_batch"))
    judged = materialize(judged, "upload-verdicts").withColumn("batch_id", F.lit(batch_id).cast("long"))
    judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return judged
