"""Reading, fingerprinting and recognising inbox files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import literal_table
from ledgerloom.sources.contracts import CONTRACTS, alias_rows


def read_csv_strings(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column a string; short rows are padded, long rows cut."""
    return spark.read.csv(
        path, header=True, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8", multiLine=multi_line,
        enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def inbox_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per CSV file: its path, header line and number of data lines.

    The header is the first line of the block that starts the file; ids grow
    with the read order inside a block.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"), "value",
    ).withColumn("_id", F.monotonically_increasing_id())
    first = F.when(F.col("_start") == 0, F.col("_id"))
    return lines.groupBy("file_path").agg(
        F.min_by("value", first).alias("header"), (F.count_if(F.col("value") != "") - 1).alias("rows"),
    ).orderBy("file_path")


def file_hashes(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def new_files(hashes: DataFrame, file_log: DataFrame) -> DataFrame:
    """Files whose content was not loaded successfully before."""
    done = file_log.filter("status = 'success'").select("file_hash")
    return hashes.join(done, "file_hash", "left_anti")


def alias_table(spark: SparkSession, overrides: list[tuple[str | None, str, str]] = ()) -> DataFrame:
    return literal_table(spark, ["table_name", "header", "canonical"], alias_rows(overrides))


def detect_table(
    headers: DataFrame, with_key: bool = False, minimum: float = 0.5, tie_fails: bool = True,
    overrides: list[tuple[str | None, str, str]] = (),
) -> DataFrame:
    """Score every contract by the share of required columns a header covers.

    ``headers`` has ``file_path`` and ``header``. The plain form takes required
    columns, needs half of them and refuses a tie; the upload form adds the key
    columns, needs 0.4 and takes the first best contract.
    """
    spark = headers.sparkSession
    wanted = literal_table(spark, ["table_name", "canonical", "position"], [
        (c.name, column, position)
        for position, c in enumerate(CONTRACTS.values())
        for column in dict.fromkeys([*(c.key if with_key else ()), *c.required])
    ])
    total = wanted.groupBy("table_name", "position").agg(F.count(F.lit(1)).alias("_all"))
    found = headers.select("file_path", F.explode(F.split("header", ",")).alias("_raw")).select(
        "file_path", F.lower(F.trim(F.regexp_replace("_raw", '^"|"$', ""))).alias("header"))
    hits = found.join(F.broadcast(alias_table(spark, overrides)), "header").join(
        F.broadcast(wanted), ["table_name", "canonical"]).groupBy("file_path", "table_name").agg(
        F.count_distinct("canonical").alias("_hit"))
    scored = hits.join(F.broadcast(total), "table_name").withColumn("score", F.col("_hit") / F.col("_all"))
    best = Window.partitionBy("file_path").orderBy(F.desc("score"), "position")
    ranked = scored.withColumn("_rank", F.row_number().over(best)).withColumn(
        "_next", F.lead("score").over(best)).filter("_rank = 1")
    tie = (F.col("_next") == F.col("score")) if tie_fails else F.lit(False)
    verdict = F.when(F.col("score") < minimum, "no match").when(tie, "tie").otherwise("ok")
    return headers.select("file_path").join(ranked, "file_path", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))).withColumn("verdict", verdict).select(
        "file_path", F.when(F.col("verdict") == "ok", F.col("table_name")).alias("table_name"), "score", "verdict")
