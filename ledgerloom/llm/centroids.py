"""Centroid clustering over subvector dictionaries.

Vectors become integers, ``floor(SCALE * x)``. Rows are taken in blocks, and the dimensions
in groups of ``WIDTH``: for each group a block holds the distinct subvectors that its rows
have there, and for each row the code of its own. Nothing is lost by this encoding. In a
round a task computes the exact distance of each distinct subvector to each centroid once,
and the distance of a vector is the sum of what stands under its codes. New centroids come
from the same codes: how many rows of a cluster have a code, times its subvector. The
blocks are written once and no vector is moved between tasks; a task returns one count and
one sum a dimension for each cluster, so a very common vector costs what others cost.

All arithmetic is on integers. A component may be up to 2**27 in size, above which a
distance could pass 64 bits: that is an error, as is an inertia beyond 64 bits.

Only vectors of exactly ``dims`` components, none of them null, NaN or infinite, take part;
all other rows, null vectors included, are left out. A null id is kept and hashed as the
empty text. Rows that repeat an id are vectors of their own; ties of the hash go to the
smaller vector. With fewer than ``clusters`` vectors there are as many centroids as vectors.
An empty table returns no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.steps import materialize

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Dimensions of a subvector.
WIDTH = 2
#: Rows of a block, at most; codes have 16 bits.
BLOCK_ROWS = 1 << 16
#: Largest size of a component for which distances stay within 64 bits.
LARGEST = 1 << 27


def usable(column: str, dims: int = DIMS) -> F.Column:
    """Whether a vector has ``dims`` components, all of them finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(column) == dims) & finite, F.lit(False))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST / SCALE:g}: distances would pass 64 bits")
    return scaled.astype(np.int32)


def _packed(matrix: np.ndarray, width: int) -> tuple[list[int], bytes, bytes]:
    """Sizes of the dictionaries, the dictionaries one after another, and the codes by group of dimensions."""
    kind = {1: np.dtype(np.int32), 2: np.dtype(np.int64)}.get(width, np.dtype((np.void, 4 * width)))
    sizes, dictionaries, codes = [], [], []
    for at in range(0, matrix.shape[1], width):
        part = np.ascontiguousarray(matrix[:, at : at + width])
        distinct, code = np.unique(part.view(kind if part.shape[1] == width else np.dtype((np.void, 4 * part.shape[1]))).ravel(), return_inverse=True)
        sizes.append(len(distinct))
        dictionaries.append(distinct.tobytes())
        codes.append(code.astype(np.uint16).tobytes())
    return sizes, b"".join(dictionaries), b"".join(codes)


def encode(vectors: DataFrame, id_column: str, column: str, dims: int = DIMS, width: int = WIDTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of usable vectors: (ids, n, sizes, dictionary, codes)."""
    if block_rows > 1 << 16:
        raise ValueError("codes have 16 bits")
    kind = vectors.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held])
            sizes, dictionary, codes = _packed(whole_numbers(flat).reshape(-1, dims), width)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(ids)], pa.int32()),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([dictionary], pa.binary()), pa.array([codes], pa.binary())],
                ["ids", "n", "sizes", "dictionary", "codes"])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                held.append(batch.slice(start, block_rows - sum(b.num_rows for b in held)))
                start += held[-1].num_rows
                if sum(b.num_rows for b in held) == block_rows:
                    yield block()
                    held.clear()
        if held:
            yield block()

    kept = vectors.filter(usable(column, dims)).select(F.col(id_column).alias("id"), F.col(column).alias("vector"))
    return kept.mapInArrow(run, f"ids array<{kind}>, n int, sizes array<int>, dictionary binary, codes binary")


class Block:
    """The subvectors and codes of one block of rows."""

    def __init__(self, row: dict, dims: int, width: int) -> None:
        self.n, self.dims = row["n"], dims
        values, codes = np.frombuffer(row["dictionary"], np.int32), np.frombuffer(row["codes"], np.uint16).reshape(-1, row["n"])
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []
        taken = 0
        for group, size in enumerate(row["sizes"]):
            wide = min(width, dims - group * width)
            self.groups.append((group * width, values[taken : taken + size * wide].reshape(size, wide).astype(np.int64), codes[group]))
            taken += size * wide

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the smaller number on ties, and the squared distance."""
        distance = np.zeros((self.n, len(centroids)), np.int64)
        for at, subvectors, codes in self.groups:
            away = subvectors[:, None, :] - centroids[None, :, at : at + subvectors.shape[1]]
            distance += (away * away).sum(axis=2)[codes]
        cluster = distance.argmin(axis=1)
        return cluster, distance[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The sum of the vectors of each cluster."""
        out = np.zeros((k, self.dims), np.int64)
        for at, subvectors, codes in self.groups:
            many = np.bincount(cluster * len(subvectors) + codes, minlength=k * len(subvectors)).reshape(k, -1)
            out[:, at : at + subvectors.shape[1]] = many @ subvectors
        return out


def first_centroids(vectors: DataFrame, id_column: str, column: str, k: int, dims: int, seed: int) -> np.ndarray:
    """The ``k`` usable vectors of least hash, in ascending order of it."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256).alias("hash")
    found = vectors.filter(usable(column, dims)).select(named, F.col(column).alias("vector")).orderBy("hash", "vector").limit(k).collect()
    return whole_numbers(np.array([r["vector"] for r in found], np.float64).reshape(-1, dims)).astype(np.int64)


def cluster_vectors(vectors: DataFrame, id_column: str, column: str, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    dims: int = DIMS, width: int = WIDTH, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) for each usable vector, and the final centroids."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    centroids = first_centroids(vectors, id_column, column, clusters, dims, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids
    blocks = materialize(encode(vectors, id_column, column, dims, width, block_rows), "subvectors")

    def gather(batches: Iterator[pa.RecordBatch], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row a cluster for a whole task."""
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], dims, width)
                cluster, _ = block.nearest(at)
                counts += np.bincount(cluster, minlength=len(at))
                sums += block.sums(cluster, len(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(at)), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    for _ in range(rounds):
        parts = blocks.select("n", "sizes", "dictionary", "codes").mapInArrow(lambda b, at=centroids: gather(b, at), "cluster int, n long, sums array<long>")
        by_dim = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("dim", "value"))
        # One row for each cluster and dimension, however many vectors there are.
        for row in by_dim.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect():
            if row["n"]:
                centroids[row["cluster"], row["dim"]] = int(row["total"]) // int(row["n"])

    def assign(batches: Iterator[pa.RecordBatch], at: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                cluster, distance = Block(one.select(["n", "sizes", "dictionary", "codes"]).to_pylist()[0], dims, width).nearest(at)
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return blocks.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    assigned = materialize(assigned, "assigned")
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    total = sum(int(r["total"]) for r in per_cluster)
    rows = [(r["cluster"], int(r["total"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in per_cluster]
    # At most one row a centroid.
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
