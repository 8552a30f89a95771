"""Document fingerprints by order min-hash.

A text is its sequence of overlapping ``SIZE``-word k-mers, the last closed by an end
mark, each numbered by how often it has occurred so far. For each of ``SLOTS`` hash
functions the ``TUPLE`` numbered k-mers of least hash are kept in the order they have in
the text, and the hash of that tuple is the slot of the fingerprint. Two texts agree on a
slot only if they share the k-mers and their order, so the share of equal slots falls
with the edit distance, not just with the common content. Words of over 24 characters
are cut, so texts without white space have k-mers too.

``with_next`` gives each row the text of the next doc_id. Rows are dealt by ranges of
doc_id and sorted in them; the first row of a range is also sent to the range before it,
so no text is moved more than once besides those. A null doc_id comes first; rows of one
doc_id are ordered by their texts; null texts are empty. A text without words has the
fingerprint of no k-mers. A table of one row has that row as its own next; an empty table
returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, hashes, mix, slices, words

SIZE, TUPLE, SLOTS = 2, 2, 32
#: Text characters in a range of doc_ids, on average.
RANGE_CHARS = 8 << 20
_END = np.uint64(0xA0761D6478BD642F)
_FACTORS = np.random.default_rng(11).integers(0, 2**63, (SLOTS, 2), dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(2**64 - 1)


def _numbered(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every numbered k-mer in text order, and where each text starts."""
    long = pc.match_substring_regex(texts, r"\S{25}")
    if pc.any(long).as_py():
        texts = pc.if_else(long, pc.replace_substring_regex(texts, r"(\S{12})", r"\1 "), texts)
    split = words(texts)
    if not len(split.codes):
        return np.zeros(0, np.uint64), split.starts
    symbols = np.concatenate([hashes(split.distinct)[split.codes], np.full(size, _END)])
    owner = split.owner
    last = split.starts[1:][owner]
    at = np.arange(len(owner))
    key = np.zeros(len(owner), np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < last, symbols[k : k + len(owner)], _END)
    own = mix(key ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    opens = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    occurrence = np.empty(len(own), np.uint64)
    occurrence[order] = at - np.repeat(opens, np.diff(np.append(opens, len(own))))
    return mix(key + occurrence * np.uint64(0xD6E8FEB86659FD93)), split.starts


def fingerprints(texts: pa.Array, size: int = SIZE) -> np.ndarray:
    """One row of ``SLOTS`` 32-bit hashes per text."""
    numbered, starts = _numbered(texts, size)
    counts = np.diff(starts)
    out = np.zeros((len(texts), SLOTS), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first, many = starts[:-1][full], counts[full]
    for slot, (mask, factor) in enumerate(_FACTORS):
        value = (numbered ^ mask) * factor
        value ^= value >> np.uint64(32)
        picked = []
        for _ in range(TUPLE):
            least = np.minimum.reduceat(value, first)
            # Numbered k-mers of a text differ, so one place has the least value; after the last k-mer none is left.
            here = np.flatnonzero(value == np.repeat(least, many))
            here = here[np.append(True, np.searchsorted(first, here[1:], side="right") != np.searchsorted(first, here[:-1], side="right"))]
            picked.append(np.where(least == _TOP, -1, here))
            value[here] = _TOP
        places = np.sort(np.stack(picked), axis=0)
        tuple_hash = np.zeros(len(full), np.uint64)
        for row in places:
            tuple_hash = mix(tuple_hash * np.uint64(0x9E3779B97F4A7C15) + np.where(row < 0, _END, numbered[row]))
        out[full, slot] = (tuple_hash >> np.uint64(32)).astype(np.uint32)
    return out


def as_text(prints: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in prints]


def with_next(docs: DataFrame, run, schema: str, range_chars: int | None = None) -> DataFrame:
    """Apply ``run`` to the rows (doc_id, text) of each range in ascending order.

    ``run`` gets batches with columns range, guest, doc_id, text. In a range guests come last:
    the first one is the row after the range's last own row.
    """
    lowest = -(2**63)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (range_chars or RANGE_CHARS)))
    cuts = keyed.agg(F.percentile_approx("key", [k / n for k in range(n)], 10_000)).first()[0] if n > 1 else [lowest]
    cuts = np.unique(np.array(cuts or [lowest], np.int64))

    def range_of(keys: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(cuts, keys, side="right") - 1, 0)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            frame = pa.table({"range": range_of(keys), "key": keys}).group_by("range").aggregate([("key", "min")])
            yield pa.RecordBatch.from_arrays([frame["range"].combine_chunks(), frame["key_min"].combine_chunks()], ["range", "key"])

    # One row per range: the number of ranges is the size of the text over ``range_chars``.
    least = dict(sorted(map(tuple, keyed.select("key").mapInArrow(smallest, "range long, key long").groupBy("range").agg(F.min("key")).collect())))
    ranges = list(least)
    #: For the first key of each range, the range before it, which gets the row as a guest.
    before = {least[r]: ranges[i - 1] for i, r in enumerate(ranges)}
    heads = np.array(sorted(before), np.int64)
    goes_to = np.array([before[k] for k in heads.tolist()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            own = pa.array(range_of(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(len(keys), bool)), *batch.columns], ["range", "guest", *batch.schema.names])
            at = np.minimum(np.searchsorted(heads, keys), max(len(heads) - 1, 0))
            first = np.flatnonzero(heads[at] == keys) if len(heads) else np.zeros(0, int)
            if len(first):
                part = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(goes_to[at[first]]), pa.array(np.ones(len(first), bool)), *part.columns], ["range", "guest", *batch.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = keyed.mapInArrow(deal, f"range long, guest boolean, doc_id {kind}, text string, key long")
    parts = max(1, min(2 * n, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "guest", "key", "text")
    return ordered.select("range", "guest", "doc_id", "text").mapInArrow(run, schema)


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and its likeness to the next text and to an edited one.

    In the edited text the last half of the characters gives way to the first as many of the next text.
    """

    def judge(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + after[:h] for t, h, after in zip(texts, halves, following, strict=True)]
        own, changed, after = (fingerprints(pa.array(x, pa.string())) for x in (texts, edited, following))
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], id_type), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(own)), pa.array(as_text(changed)),
            pa.array((own == changed).mean(axis=1)), pa.array((own == after).mean(axis=1)),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in slices(batches):
            rows, following = [], []
            columns = (batch.column("range").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), filled(batch, "text").to_pylist())
            for place, guest, doc_id, text in zip(*columns, strict=True):
                if held is not None:
                    rows.append(held[:2])
                    following.append(text)
                held = None if guest else (doc_id, text, place)
            if rows:
                yield judge(rows, following)

    id_type = {"bigint": pa.int64(), "int": pa.int32()}[docs.schema["doc_id"].dataType.simpleString()]
    return with_next(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
