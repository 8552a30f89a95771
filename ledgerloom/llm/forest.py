"""Jaccard self-join of documents on word shingles by a MinHash LSH forest.

Texts are sets of ``SIZE``-word shingles (lower-cased words; a shorter text is one
shingle of all its words). Each distinct text has ``TREES`` labels of ``DEEPEST`` min-hashes;
sorted by one label, texts are the leaves of a prefix trie. Texts that share a prefix of
a tree are candidates. Prefixes are shortened until pairs at the threshold are found with
the target recall, and, as long as the similarities of the verified pairs say that the
recall is short of it, further. Every candidate is verified on the whole shingle sets.

Groups of up to ``CROWD`` texts on a prefix give pairs. Texts of larger groups are put
together into crowds, whose pairs are verified block by block with matrix products; a
block returns the number of links of each text and one link to its group, so a crowd
never becomes rows of pairs.

Equal texts are one variant, so copies are not compared. Null texts count as empty, and
texts without words have no links; equal ones share a class. A null doc_id counts as the
smallest id in a class and is kept. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.text import filled, hashes, mix, ngrams, slices, words
from ledgerloom.llm.steps import materialize

SIZE, SIMILARITY, TREES, DEEPEST, TARGET = 5, 0.8, 32, 8, 0.9999
CROWD, BLOCK = 64, 512
#: Candidates whose min-hashes agree this much less than the threshold are not similar: six standard errors.
SLACK = 6 * (SIMILARITY * (1 - SIMILARITY) / (TREES * DEEPEST)) ** 0.5
#: Rows of an id list that is sent to every task; a longer one is joined by a shuffle.
FEW = 1_000_000
_FACTORS = np.random.default_rng(17).integers(0, 2**32, (TREES * DEEPEST, 2), dtype=np.uint32) | np.uint32(1)


def shingles(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and where each text starts."""
    split = words(texts, lower=True)
    if not len(split.codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    symbols = hashes(split.distinct)[split.codes]
    counts = split.counts
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(split.starts[:-1] - starts[:-1], many) + np.arange(starts[-1])
    out = np.zeros(len(at), np.uint64)
    length = np.minimum(counts, size)
    for k in range(1, size + 1):
        here = np.repeat(length == k, many)
        if here.any():
            out[here] = ngrams(symbols, k)[at[here]]
    return out, starts


def signatures(texts: pa.Array) -> np.ndarray:
    """16-bit min-hashes, ``TREES * DEEPEST`` a text; texts without words get zeros."""
    values, starts = shingles(texts)
    out = np.zeros((len(texts), TREES * DEEPEST), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        short = (values >> np.uint64(32)).astype(np.uint32)
        for k, (mask, factor) in enumerate(_FACTORS):
            least = np.minimum.reduceat((short ^ mask) * factor, starts[:-1][full])
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def recall(similarity: float, depth: int) -> float:
    """The chance that a pair has a prefix of ``depth`` in common in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def variants(docs: DataFrame) -> DataFrame:
    """(id, signature, first, copies, n) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            texts = filled(batch, "text")
            rows = signatures(texts)
            filled_in = rows.any(axis=1)
            blobs = pa.array([r.tobytes() if f else None for r, f in zip(rows, filled_in, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), blobs], ["id", "doc_id", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(text_id().alias("id"), "doc_id", "text").mapInArrow(run, f"id long, doc_id {kind}, signature binary")
    return rows.groupBy("id").agg(F.first("signature").alias("signature"), F.count("*").alias("copies"),
                                  F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))


def text_id() -> Column:
    """A 64-bit hash that stands for the whole text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def forest(known: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, id) for each variant with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES, DEEPEST)
            prefix = np.zeros(labels.shape[:2], np.uint64)
            for k in range(depth):
                prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, k] + np.uint64(1))
            n = len(labels)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(prefix.ravel().view(np.int64)),
                 batch.column("id").take(pa.array(np.repeat(np.arange(n), TREES)))], ["tree", "prefix", "id"])

    return known.filter("signature IS NOT NULL").select("id", "signature").mapInArrow(run, "tree int, prefix long, id long")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the sorted distinct shingles of the texts with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, starts = shingles(filled(batch, "text"))
            blobs = [np.unique(values[a:b]).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], ["id", "shingles"])

    texts = docs.select(text_id().alias("id"), "text").join(_few(ids), "id")
    return texts.mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def verified_pairs(pairs: DataFrame, known: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the pairs at or over the threshold."""
    marks = [known.select(F.col("id").alias(k), F.col("signature").alias(f"signature_{k}")) for k in "ab"]

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(f"signature_{k}").to_pylist()), np.uint16).reshape(-1, TREES * DEEPEST) for k in "ab")
            yield batch.select(["a", "b"]).filter(pa.array((one == two).mean(axis=1) >= similarity - SLACK))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in
                              zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True)])
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "jaccard"])
            yield kept.filter(pa.array(found >= similarity, pa.bool_()))

    likely = materialize(pairs.join(marks[0], "a").join(marks[1], "b").mapInArrow(agree, "a long, b long"), "forest-likely")
    ids = materialize(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct(), "forest-ids")
    sets = materialize(shingle_sets(docs, ids), "forest-sets")
    left, right = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"shingles_{k}")) for k in "ab")
    return likely.join(left, "a").join(right, "b").mapInArrow(exact, "a long, b long, jaccard double")


def _overlaps(sets: list[np.ndarray], own: int) -> np.ndarray:
    """Sizes of the intersections of the first ``own`` sets with all the sets."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    member, value = member[order], value[order]
    opens = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    many = np.diff(np.append(opens, len(value)))
    df = np.repeat(many, many)
    shared = np.zeros((own, len(sets)), np.float32)
    # Rare shingles are paired off; the common ones make dense columns.
    rare_m, rare_v = member[(df > 1) & (df <= 16)], value[(df > 1) & (df <= 16)]
    for shift in range(1, 16):
        same = rare_v[shift:] == rare_v[:-shift] if len(rare_v) > shift else np.zeros(0, bool)
        for i, j in ((rare_m[:-shift][same], rare_m[shift:][same]), (rare_m[shift:][same], rare_m[:-shift][same])):
            np.add.at(shared, (i[i < own], j[i < own]), 1)
    common = np.flatnonzero(many > 16)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        column = np.repeat(np.arange(len(part)), many[part])
        rows = member[np.repeat(opens[part] - np.cumsum(many[part]) + many[part], many[part]) + np.arange(many[part].sum())]
        dense = np.zeros((len(sets), len(part)), np.float32)
        dense[rows, column] = 1
        shared += dense[:own] @ dense.T
    return shared


def crowd_links(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(id, links, other) from every block of each crowd: the links of a text in it, and a text of its group."""
    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sets = shingle_sets(docs, members.select("id"))
    dealt = placed.join(sets, "id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("crowd", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "id", "shingles")

    def run(table: pa.Table) -> pa.Table:
        low = table["one"][0].as_py()
        table = table.sort_by([("own", "ascending"), ("id", "ascending")])
        ids, block = table["id"].to_numpy(), table["own"].to_numpy()
        sets_here = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        own = int((block == low).sum())
        single = own == len(ids)
        shared = _overlaps(sets_here, own)
        length = np.array([len(s) for s in sets_here])
        linked = shared >= similarity * (length[:own, None] + length[None, :] - shared) - 1e-6
        # Texts of one block meet in the task of that block alone.
        linked[np.arange(own), np.arange(own)] = False
        if not single:
            linked[:, :own] = False
        links = np.zeros(len(ids), np.int64)
        links[:own] += linked.sum(axis=1)
        if not single:
            links += linked.sum(axis=0)
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            low_of_row = np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids))
            label[:own] = np.minimum(label[:own], low_of_row)
            low_of_column = np.where(linked, label[:own, None], len(ids)).min(axis=0, initial=len(ids))
            label = np.minimum(label, low_of_column)
        found = links > 0
        return pa.table({"id": ids[found], "links": links[found], "other": ids[label[found]]})

    return dealt.groupBy("crowd", "one", "two").applyInArrow(run, "id long, links long, other long")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    """(doc_id, text_id, class_id, n_links, n_copies) of each row.

    A class holds the documents that links connect, and is named by its smallest doc_id; n_links counts the other
    texts at or over ``similarity``, n_copies the rows with the same text, this one included.
    """
    known = materialize(variants(docs), "forest-variants")
    depth = next((d for d in range(DEEPEST, 0, -1) if recall(float(similarity), d) >= target), 1)
    while True:
        rows = forest(known, depth)
        groups = rows.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("id").alias("head")).filter("size > 1")
        hits = materialize(rows.join(groups, ["tree", "prefix"]), "forest-hits")
        label = components(hits.filter(F.col("size") > CROWD).select(F.col("id").alias("a"), F.col("head").alias("b")))
        crowd = materialize(label.withColumnRenamed("component", "crowd"), "forest-crowds")
        crowded = materialize(crowd_links(crowd, docs, similarity), "forest-crowd-links")
        small = hits.filter(F.col("size") <= CROWD).join(crowd, "id", "left").select("tree", "prefix", "id", "crowd")
        left, right = (small.select("tree", "prefix", F.col("id").alias(k), F.col("crowd").alias(f"crowd_{k}")) for k in "ab")
        met = left.join(right, ["tree", "prefix"]).filter("a < b AND NOT coalesce(crowd_a = crowd_b, false)").select("a", "b").distinct()
        checked = materialize(verified_pairs(met, known, docs, similarity), "forest-pairs")
        # Each verified pair stands for as many as its chance of being found allows for.
        found = checked.agg(F.count("*"), F.sum(1 / (1 - F.pow(1 - F.pow("jaccard", F.lit(depth)), F.lit(TREES))))).first()
        if depth == 1 or not found[0] or found[0] / found[1] >= target:
            break
        depth -= 1
    counts = crowded.groupBy("id").agg(F.sum("links").alias("links")).union(
        checked.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links")))
    counts = counts.groupBy("id").agg(F.sum("links").alias("n_links"))
    group = components(checked.select("a", "b").union(crowded.select(F.col("id").alias("a"), F.col("other").alias("b"))))
    named = known.select("id", "first", "copies").join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.filter(F.col("component") != F.col("id")).select("component").distinct()
    least = named.join(names, "component").groupBy("component").agg(F.min("first").alias("least"))
    result = materialize(
        named.join(least, "component", "left").join(counts, "id", "left")
        .select(F.col("id").alias("text_id"), F.coalesce("least", "first")["doc_id"].alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies")),
        "forest-classes")
    return docs.select("doc_id", text_id().alias("text_id")).join(result, "text_id").select("doc_id", "text_id", "class_id", "n_links", "n_copies")


def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_id")
