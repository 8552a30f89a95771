"""Token counts of documents in flat, unindexed token files, found by scanning for separators.

A token file is nothing but 16-bit little-endian token ids; an end-of-document id
closes each document. Files are read in blocks; in a block one vectorised search finds
the separators. A document that crosses blocks is stitched by a prefix scan over one
summary row per block: the running maximum of the last separator tells where the
document closed by a block began.

``write_token_files`` makes such files from texts with Spark's text sink, whose line
separator is the end-of-document id. It may put a header of ``HEADER`` tokens before
each document that spells its doc_id, so that files need no index beside them.

Null texts are empty documents of no tokens; a null doc_id is kept; repeated rows are
documents of their own. A last document without a separator is reported with
``closed`` false. An empty table writes files without documents and returns no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, slices
from ledgerloom.session import scratch_dir

#: Tokens before a document that spell its id: kind, then digits below ``DIGITS``.
HEADER, DIGITS = 6, 8192
END = 50256
BLOCK_BYTES = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def spell(ids: pa.Array) -> np.ndarray:
    """Headers of ids: 0, 1 or 2 for a plain, negative or missing id, then five digits."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(value), HEADER), np.uint16)
    out[:, 0] = np.where(missing, 2, value < 0)
    rest = np.where(value < 0, ~value, value)
    for k in range(1, HEADER):
        out[:, k] = rest % DIGITS
        rest //= DIGITS
    return out


def read_ids(headers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that headers spell, and which are missing."""
    value = np.zeros(len(headers), np.int64)
    for k in range(HEADER - 1, 0, -1):
        value = value * DIGITS + headers[:, k]
    return np.where(headers[:, 0] == 1, ~value, value), headers[:, 0] == 2


def write_token_files(docs: DataFrame, path: str, ranks: dict[bytes, int], pattern: str, end: int = END, header: bool = True) -> None:
    """Encode texts and write them as token files, one per partition of ``docs``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in slices(batches):
            heads = spell(batch.column("doc_id")) if header else np.zeros((batch.num_rows, 0), np.uint16)
            rows = [head.tobytes() + np.array(encoder.encode_ordinary(text), np.uint16).tobytes()
                    for head, text in zip(heads, filled(batch, "text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["tokens"])

    tokens = docs.select("doc_id", "text").mapInArrow(encode, "tokens binary").select(F.col("tokens").cast("string"))
    separator = np.array([end], "<u2").tobytes().decode("latin-1")
    tokens.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token files as (file, block, size, data); data goes on for a header's length past the block's own ``size`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    cut = F.transform(starts, lambda i: F.substring(F.col("content"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes + 2 * HEADER)))
    blocks = files.filter(F.col("length") > 0).select(F.col("path").alias("file"), "length", F.posexplode(cut).alias("block", "data"))
    return blocks.select("file", F.col("block").cast("long").alias("block"),
                         F.least(F.lit(block_bytes).cast("long"), F.col("length") - F.col("block").cast("long") * block_bytes).alias("size"), "data")


_FOUND = "file string, block long, inside boolean, doc_id long, n_tokens long, first long, last long, next_id long, stop long"


def count_tokens(blocks: DataFrame, end: int = END, header: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id (null without headers), n_tokens, closed, and its file."""
    lead = HEADER if header else 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, size, data in zip(*(batch.column(k).to_pylist() for k in ("file", "block", "size", "data")), strict=True):
                tokens = np.frombuffer(data, "<u2", len(data) // 2)
                own = tokens[: size // 2]
                at = block * (block_bytes // 2)
                seps = np.flatnonzero(own == end)
                starts = seps[:-1] + 1
                # Starts of documents: after each separator, and at the start of the file.
                heads = np.concatenate([starts, seps[-1:] + 1, [0] if block == 0 else []]).astype(np.int64)
                padded = np.append(tokens, np.full(HEADER, 2, np.uint16))
                ids, missing = read_ids(padded[np.minimum(heads, len(tokens))[:, None] + np.arange(HEADER)]) if header else (
                    np.zeros(len(heads), np.int64), np.ones(len(heads), bool))
                n, last = len(starts), int(seps[-1]) + at if len(seps) else None
                opening = [None if missing[k] else int(ids[k]) for k in range(n, len(heads))]
                # The document that is open at the end of the block is the last that starts in it.
                following = opening[0] if len(seps) else (opening[-1] if block == 0 else None)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * (n + 1)), pa.array([block] * (n + 1), pa.int64()), pa.array([True] * n + [False]),
                    pa.array([*(None if m else int(i) for i, m in zip(ids[:n], missing[:n], strict=True)), opening[-1] if block == 0 else None], pa.int64()),
                    pa.array([*(np.diff(seps) - 1 - lead), None], pa.int64()),
                    pa.array([None] * n + [int(seps[0]) + at if len(seps) else None], pa.int64()),
                    pa.array([None] * n + [last], pa.int64()),
                    pa.array([None] * n + [following], pa.int64()),
                    pa.array([None] * n + [at + size // 2], pa.int64()),
                ], ["file", "block", "inside", "doc_id", "n_tokens", "first", "last", "next_id", "stop"])

    found = blocks.mapInArrow(scan, _FOUND)
    inside = found.filter("inside").select("doc_id", "n_tokens", F.lit(True).alias("closed"), "file")
    # One row per block of a file: a running maximum carries the last separator over blocks without one.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opened = F.when(F.col("last").isNotNull() | (F.col("block") == 0), F.struct(F.coalesce("last", F.lit(-1)).alias("sep"), F.col("next_id").alias("id")))
    edges = (found.filter("NOT inside").withColumn("opened", opened)
             .withColumn("open_before", F.max("opened").over(before)).withColumn("open_after", F.max("opened").over(whole))
             .withColumn("end", F.max("stop").over(whole)).withColumn("last_block", F.max("block").over(whole)))
    began = F.coalesce("open_before", F.struct(F.lit(-1).cast("long").alias("sep"), F.col("doc_id").alias("id")))
    crossing = edges.filter(F.col("first").isNotNull()).select(
        began["id"].alias("doc_id"), (F.col("first") - began["sep"] - 1 - lead).alias("n_tokens"), F.lit(True).alias("closed"), "file")
    left = edges.filter((F.col("block") == F.col("last_block")) & (F.col("end") - F.col("open_after.sep") - 1 > 0)).select(
        F.col("open_after.id").alias("doc_id"), (F.col("end") - F.col("open_after.sep") - 1 - lead).alias("n_tokens"), F.lit(False).alias("closed"), "file")
    return inside.unionByName(crossing).unionByName(left)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are encoded into token files in the shared folder, and these are scanned."""
    path = scratch_dir(spark, "token-files")
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, ranks, public_tokenizers.PATTERN)
    return count_tokens(read_blocks(spark, path)).select("doc_id", "n_tokens", "closed")
