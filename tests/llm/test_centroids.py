"""Subvector dictionaries against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerloom.llm.centroids import LARGEST, SCALE, cluster_vectors, op13_centroid_clustering


def brute_force(rows, k, rounds, dims):
    kept = [(i, [math.floor(SCALE * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in named[:k]]

    def nearest(v):
        away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted(((i, *nearest(v)) for i, v in kept), key=str), cents


def frame(spark, rows, dims="double"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{dims}>, cluster string, distance int")


@pytest.mark.parametrize("width,dims", [(1, 6), (2, 6), (2, 5), (4, 6)])
def test_equal_to_plain_clustering(spark, width, dims):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-0.25, 0.1, 0.5, 2.0]) + rng.gauss(0, 0.01) * (i % 3) for _ in range(dims)]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a very common vector
    rows += [(7, rows[7][1]), (None, rows[3][1]), (8, rows[9][1])]  # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dims + 1)), (2003, [None] + [0.0] * (dims - 1)),
             (2004, [float("nan")] * dims), (2005, [float("-inf")] + [0.0] * (dims - 1))]
    found, cents = cluster_vectors(frame(spark, rows).repartition(3), "vec_id", "embedding", clusters=4, rounds=5, dims=dims, width=width, block_rows=50)
    want, want_cents = brute_force(rows, 4, 5, dims)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert cents.tolist() == want_cents


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)]
    found, cents = cluster_vectors(frame(spark, rows), "vec_id", "embedding", clusters=3, rounds=2, dims=2)
    assert {(r["cluster"], r["distance"]) for r in found.collect()} == {(0, 0)}
    assert len(cents) == 3


def test_few_and_no_vectors(spark):
    found, cents = cluster_vectors(frame(spark, [(1, [0.5, 0.5]), (2, None)]), "vec_id", "embedding", clusters=8, dims=2, rounds=3)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0)] and len(cents) == 1
    assert cluster_vectors(frame(spark, []), "vec_id", "embedding", dims=2)[0].collect() == []


def test_components_beyond_64_bit_distances_are_an_error(spark):
    with pytest.raises(ArithmeticError):
        cluster_vectors(frame(spark, [(1, [2.0 * LARGEST, 0.0])]), "vec_id", "embedding", dims=2)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.1, 64).astype(np.float32).tolist()) for i in range(60)] + [(99, None)]
    frame(spark, rows, "float").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in op13_centroid_clustering(spark, str(tmp_path)).collect()}
    want, cents = brute_force(rows, 8, 10, 64)
    assert {i: (r["cluster"], r["distance"]) for i, r in got.items()} == {i: (c, d) for i, c, d in want}
    for i, c, _ in want:
        assert got[i]["cluster_inertia"] == sum(d for _, k, d in want if k == c)
        assert got[i]["inertia"] == sum(d for *_, d in want)
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, [], "float").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op13_centroid_clustering(spark, str(tmp_path)).collect() == []
