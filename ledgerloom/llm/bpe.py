"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern, and each slice of a partition lists its
distinct pieces once. Ranked merges are folded over the bytes of all distinct pieces
together: in each round every piece joins its leftmost pair of lowest rank, until no
piece has a pair with a rank. Documents then read the ids of their pieces. All of it is
one narrow stage, nothing is shuffled. Decoding is Spark's: the bytes of each id, from
a literal array, are joined by higher-order functions.

``fold_expression`` is the same fold as Spark higher-order functions over a literal
rank map. It gives the same ids but takes some 40 times the time for a piece (README),
so ``encode`` does without it.

A piece of more than ``LONG`` bytes is merged with a heap, with the same result, because
the fold takes time with the square of the length. Null texts encode to no ids; ids
that the ranks do not know decode to nothing. Rows are kept as they are, repeated ones
too; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, slices
from ledgerloom.llm.tokenfiles import load_ranks

LONG = 200
#: Text bytes whose distinct pieces are folded together.
PIECE_SLICE = 24 << 20
_MAPS = 1 << 14
_NONE = 2**31 - 1


def _rank_maps(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of maps from hexadecimal bytes to rank."""
    maps: list[dict[str, int]] = [{} for _ in range(_MAPS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % _MAPS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _looked_up(keys: Column, maps: Column) -> Column:
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.get(maps, (F.crc32(k) % _MAPS).cast("int")), k), F.lit(_NONE)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(acc: Column, maps: Column) -> Column:
    """One merge: the leftmost pair of lowest rank becomes one part."""
    none = F.array().cast("array<string>")

    def join(at: Column) -> Column:
        i, rank = at["i"], at["rank"]
        new = F.concat(F.get(acc["parts"], i - 1), F.get(acc["parts"], i))
        left = F.when(i > 1, F.array(F.concat(F.get(acc["parts"], i - 2), new))).otherwise(none)
        right = F.when(i < F.size(acc["pairs"]), F.array(F.concat(new, F.get(acc["parts"], i + 1)))).otherwise(none)

        def spliced(values: Column, middle: Column, head: Column) -> Column:
            return F.concat(F.slice(values, F.lit(1), head), middle, F.slice(values, i + 2, F.size(values)))

        return F.struct(
            spliced(acc["parts"], F.array(new), i - 1).alias("parts"),
            spliced(acc["ids"], F.array(rank), i - 1).alias("ids"),
            spliced(acc["pairs"], _looked_up(F.concat(left, right), maps), F.greatest(i - 2, F.lit(0))).alias("pairs"))

    def step(rank: Column) -> Column:
        found = F.struct(F.array_position(acc["pairs"], rank).cast("int").alias("i"), rank.alias("rank"))
        return F.when(F.coalesce(rank, F.lit(_NONE)) < _NONE, _let(found, join)).otherwise(acc)

    return _let(F.array_min(acc["pairs"]), step)


def fold_expression(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``pieces`` with the ``ids`` of each ``piece`` (null stays null), by an expression alone."""
    maps = _rank_maps(ranks)
    places = F.sequence(F.lit(1), F.col("n"))
    hexed = pieces.withColumn("hex", F.hex(F.encode("piece", "UTF-8"))).withColumn("n", (F.length("hex") / 2).cast("int"))
    parts = F.transform(places, lambda i: F.substring(F.col("hex"), i * 2 - 1, F.lit(2)))
    pairs = F.transform(F.slice(places, F.lit(1), F.col("n") - 1), lambda i: F.substring(F.col("hex"), i * 2 - 1, F.lit(4)))
    known = hexed.withColumn("known", F.when(F.col("n") > 0, _looked_up(F.concat(F.array("hex"), parts, pairs), maps)))
    start = F.struct(parts.alias("parts"), F.slice("known", F.lit(2), F.col("n")).alias("ids"),
                     F.slice("known", F.col("n") + 2, F.col("n")).alias("pairs"))
    fold = F.aggregate(F.slice(places, F.lit(1), F.col("n") - 1), start, lambda acc, _: _merged(acc, maps), lambda acc: acc["ids"])
    whole = F.get("known", F.lit(0))
    return known.withColumn("ids", F.when(F.col("n") > 0, F.when(whole < _NONE, F.array(whole)).otherwise(fold))).drop("hex", "n", "known")


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long piece, with the pairs in a heap."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (pair := parts[k] + parts[after[k]]) in ranks:
                heapq.heappush(heap, (ranks[pair], k, parts[k], parts[after[k]]))
    return [ranks[p] for p in parts if p]


class Merges:
    """The ranks as sorted pairs of ids, to fold many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(left << 32 | right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
                 if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.values = np.array([p[1] for p in pairs], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, or ``_NONE``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def fold(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each piece has."""
        whole = [self.ranks.get(p) for p in pieces]
        done: dict[int, list[int]] = {i: merge_long(p, self.ranks) for i, p in enumerate(pieces) if whole[i] is None and len(p) > LONG}
        sizes = np.array([len(p) if whole[i] is None and i not in done else 0 for i, p in enumerate(pieces)], np.int64)
        flat = np.frombuffer(b"".join(p for p, n in zip(pieces, sizes, strict=True) if n), np.uint8)
        ids, owner = self.bytes[flat], np.repeat(np.arange(len(pieces)), sizes)
        joined = owner[1:] == owner[:-1]
        pair = np.append(np.where(joined, self.of(ids[:-1], ids[1:]), _NONE), _NONE) if len(ids) else ids
        ended = [(np.array([i for i, w in enumerate(whole) if w is not None], np.int64), np.array([w for w in whole if w is not None], np.int64)),
                 (np.array([i for i, x in done.items() for _ in x], np.int64), np.array([v for x in done.values() for v in x], np.int64))]
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(pair, starts), np.diff(np.append(starts, len(ids))))
            going = best < _NONE
            ended.append((owner[~going], ids[~going]))
            ids, owner, pair, best = ids[going], owner[going], pair[going], best[going]
            at = np.flatnonzero(pair == best)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])] if len(at) else at
            ids[at] = best[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, pair = ids[stay], owner[stay], pair[stay]
            at = at - np.arange(len(at))
            for k in (at - 1, at):
                k = k[(k >= 0) & (k + 1 < len(ids))]
                same = owner[k] == owner[k + 1]
                pair[k] = np.where(same, self.of(ids[k], ids[k + 1]), _NONE)
            pair[-1:] = _NONE
        owners, values = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(owners, kind="stable")
        return values[order].astype(np.int32), np.bincount(owners, minlength=len(pieces))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merges = regex.compile(pattern).findall, Merges(ranks)
        for batch in slices(batches, limit=PIECE_SLICE):
            index: dict[str, int] = {}
            place = index.setdefault
            codes = [np.array([place(p, len(index)) for p in find(text)], np.int32) for text in filled(batch, "text").to_pylist()]
            flat, sizes = merges.fold([p.encode() for p in index])
            first = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _gathered(codes, flat, first, sizes)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _gathered(codes: list[np.ndarray], flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each document the ids of its pieces."""
    out = []
    for picks in codes:
        count = sizes[picks]
        ends = np.cumsum(count)
        out.append(flat[np.repeat(first[picks] - ends + count, count) + np.arange(ends[-1])] if len(ends) else flat[:0])
    offsets = np.zeros(len(out) + 1, np.int32)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).astype(np.int32)))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ``ids`` stand for: the bytes of each id, one after the other."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
    shown = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
