"""Benchmark decontamination by greedy string tiling.

A tile is a run of at least ``SEED`` words that a document and a benchmark item share.
Documents and items meet on hashes of their ``SEED``-word runs. For each pair that
shares one, the longest unmarked common run is marked on both sides again and again,
found by Karp-Rabin hashes of runs of falling length, until no unmarked common run of
``SEED`` words is left. An item is leaked by a document if tiles cover at least
``COVER`` of its words; tiles may lie in any order, so a reordered passage counts.

Words are lower-cased, and everything but letters and digits parts them. Only the runs of
a document that share seeds with the benchmark leave the task that reads it, so a long
document sends little. Items of fewer than ``SEED`` words are one tile each, of all
their words. Null and empty texts have no words: such items never match, such documents
are clean. Equal items are judged each by itself; repeated rows of a document are too,
if their ids differ, and as one text if they share the id and the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, hashes, mix, ngrams, slices, words
from ledgerloom.llm.steps import materialize

SEED, COVER = 5, 0.6
#: Bits of the map of seed hashes that tasks get: a fixed size; a full map only lets more rows through to the join.
MAP_BITS = 1 << 24


def _plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and where each text starts."""
    split = words(_plain(texts))
    return (hashes(split.distinct)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)), split.starts


def seeds(symbols: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that lie in one text, and where they start."""
    found = ngrams(symbols, size)
    end = np.repeat(starts[1:], np.diff(starts))[: len(found)]
    at = np.flatnonzero(np.arange(len(found)) + size <= end)
    return found[at], at


def tiles(document: list[np.ndarray], item: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Greedy tiles (run of the document, start in it, start in the item, length) of at least ``least`` words.

    Among the longest matches the one that starts first in the document, then in the item, is marked first.
    """
    free_doc = [np.ones(len(run), bool) for run in document]
    free_item = np.ones(len(item), bool)
    longest = min(max((len(run) for run in document), default=0), len(item))
    marked = []
    while longest := _longest_shared(document, free_doc, item, free_item, least, longest):
        index: dict[int, list[int]] = {}
        for j, key in enumerate(ngrams(item, longest)):
            index.setdefault(int(key), []).append(j)
        for r, run in enumerate(document):
            for i, key in enumerate(ngrams(run, longest)):
                for j in index.get(int(key), ()):
                    # A match is marked only where both sides are still free and the words are the same.
                    mine, its = slice(i, i + longest), slice(j, j + longest)
                    if free_doc[r][mine].all() and free_item[its].all() and (run[mine] == item[its]).all():
                        free_doc[r][mine] = free_item[its] = False
                        marked.append((r, i, j, longest))
        # Whatever is still free and shared is shorter.
        longest -= 1
    return marked


def _longest_shared(document: list[np.ndarray], free_doc: list[np.ndarray], item: np.ndarray, free_item: np.ndarray, least: int, most: int) -> int:
    """The greatest length from ``least`` to ``most`` at which a free run is shared, 0 if there is none."""

    def shared(size: int) -> bool:
        def keys(run: np.ndarray, free: np.ndarray) -> np.ndarray:
            held = np.concatenate([[0], np.cumsum(~free)])
            return ngrams(run, size)[(held[size:] - held[:-size]) == 0] if len(run) >= size else np.zeros(0, np.uint64)

        own = keys(item, free_item)
        return len(own) > 0 and any(np.isin(keys(run, free), own).any() for run, free in zip(document, free_doc, strict=True))

    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low if low >= least else 0


def _item_table(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, words binary, n, seeds array, size) of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            symbols, starts = word_hashes(filled(batch, "text"))
            rows = [symbols[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            keys = [np.unique(ngrams(row, min(seed, len(row)))).view(np.int64) if len(row) else np.zeros(0, np.int64) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([min(seed, len(r)) for r in rows], pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["item_id", "words", "n", "size", "seeds"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words binary, n long, size int, seeds array<long>").filter("n > 0")


def _seed_map(table: DataFrame) -> np.ndarray:
    """A bit map of the items' seeds, built in parts of the key range; its size does not depend on the items."""
    words_of = MAP_BITS // 64
    place = F.shiftrightunsigned("seed", 40)
    bits = (table.select(F.explode("seeds").alias("seed")).select((place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit")).distinct()
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    out = np.zeros(words_of, np.int64)
    # At most MAP_BITS / 64 rows, however many items there are.
    rows = bits.toPandas()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(40)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _document_runs(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """For each text the runs that its seed hits cover, and the hit seeds: (doc_id, text_hash, runs, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = filled(batch, "text")
            symbols, starts = word_hashes(texts)
            covered = np.zeros(len(symbols) + 1, np.int64)
            found_at, found = [], []
            for size in sizes:
                keys, at = seeds(symbols, starts, size)
                hit = _in_map(bits, keys)
                keys, at = keys[hit], at[hit]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + size, -1)
                found_at.append(at)
                found.append(keys)
            inside = np.cumsum(covered)[:-1] > 0
            if not inside.any():
                continue
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            opens = inside & np.concatenate([[True], ~inside[:-1] | (owner[1:] != owner[:-1])])
            first = np.flatnonzero(opens)
            number = np.cumsum(opens) - 1
            sizes_of = np.bincount(number[inside], minlength=len(first))
            at, keys = np.concatenate(found_at), np.concatenate(found)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            docs_hit, run_from = np.unique(owner[first], return_index=True)
            blobs = [symbols[a : a + n].tobytes() for a, n in zip(first, sizes_of, strict=True)]
            runs = [blobs[a:b] for a, b in zip(run_from, [*run_from[1:], len(first)], strict=True)]
            parts = np.split(keys, np.searchsorted(owner[at], docs_hit)[1:])
            picks = pa.array(docs_hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(picks), pa.array(hashes(texts.take(picks)).view(np.int64)), pa.array(runs, pa.list_(pa.binary())),
                 pa.array([np.unique(p).view(np.int64) for p in parts], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "runs", "seeds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, runs array<binary>, seeds array<long>")


def leaks(docs: DataFrame, items: DataFrame, seed: int = SEED, cover: float = COVER) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, covered, coverage, tiles) of each pair at or over ``cover``.

    ``tiles`` lists (start in the item, length) in the order of marking.
    """
    spark = docs.sparkSession
    table = materialize(_item_table(items, seed), "bench-items")
    sizes = [r[0] for r in table.select("size").distinct().collect()]  # at most ``seed`` values
    runs = materialize(_document_runs(docs, _seed_map(table), sorted(sizes)).withColumn("row", F.monotonically_increasing_id()), "bench-runs")
    left = runs.select("row", F.explode("seeds").alias("key"))
    right = table.select("item_id", F.explode("seeds").alias("key"))
    pairs = left.join(right, "key").select("row", "item_id").distinct()
    joined = pairs.join(runs.drop("seeds"), "row").join(table.select("item_id", "words", "n", "size"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, taken = [], []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("runs", "words", "n", "size")), strict=True)):
                parts, item, n, least = row
                found = tiles([np.frombuffer(p, np.uint64) for p in parts], np.frombuffer(item, np.uint64), least)
                total = sum(t[3] for t in found)
                if total >= cover * n:
                    out.append((n, total, total / n, [{"start": t[2], "length": t[3]} for t in found]))
                    taken.append(k)
            if taken:
                kept = batch.select(["doc_id", "text_hash", "item_id"]).take(pa.array(taken))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out]),
                     pa.array([o[3] for o in out], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                    ["doc_id", "text_hash", "item_id", "n_words", "covered", "coverage", "tiles"])

    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kinds[0]}, text_hash long, item_id {kinds[1]}, n_words long, covered long, coverage double, "
                                  "tiles array<struct<start:int,length:int>>")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items that they leak; documents that leak none have no row."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return leaks(docs, items).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("covered").alias("n_covered"))
