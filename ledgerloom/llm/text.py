"""Helpers the text operators share: bounded slices, words as integer codes, and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes worked on at once in a task; one longer text is a slice of its own.
SLICE_BYTES = 6 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether a row is outside the training rows; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def filled(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column with empty texts for nulls."""
    values = batch.column(column)
    return pc.fill_null(values, "") if values.null_count else values


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` text bytes at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """White-space separated words of several texts, as codes into their distinct words."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of other bytes than space and the controls 09 to 0D."""
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.ascii_trim_whitespace(texts)
    parts = pc.ascii_split_whitespace(texts)
    # An empty text is split into one empty word, which is no word.
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    counts = np.where(empty, 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return Words(coded.indices.to_numpy(zero_copy_only=False), starts, coded.dictionary)


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets into them."""
    strings = strings.cast(pa.large_string()) if not pa.types.is_large_string(strings.type) else strings
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every string: a polynomial over its bytes, taken from running sums."""
    data, offsets = raw(strings)
    powers = np.ones(len(data) + 1, np.uint64)
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    inverse = np.ones(len(data) + 1, np.uint64)
    inverse[1:] = _BASE_INVERSE
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(_SYMBOLS + np.uint64(seed))[data] * powers[:-1], out=sums[1:])
    value = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    return mix(value + np.diff(offsets).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` symbols, whatever text it is in."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    n = len(symbols) - size + 1
    value = symbols[:n].copy()
    for i in range(1, size):
        value = value * _BASE + symbols[i : i + n]
    return mix(value)


def subwords(distinct: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of ``<word>`` and the word itself: (index of the word, bucket), by word."""
    framed = pc.binary_join_element_wise(pa.scalar("<"), distinct, pa.scalar(">"), pa.scalar(""))
    data, offsets = raw(framed)
    owner = np.repeat(np.arange(len(framed)), np.diff(offsets))
    end = offsets[1:][owner]
    place = np.arange(len(data))
    owners, found = [np.arange(len(framed))], [hashes(framed) % np.uint64(buckets)]
    value = np.zeros(len(data), np.uint64)
    for i in range(max(sizes)):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: len(data) - i] = data[i:]
        value = value * _BASE + shifted + np.uint64(1)
        if i + 1 in sizes:
            inside = place + i + 1 <= end
            owners.append(owner[inside])
            found.append(mix(value[inside]) % np.uint64(buckets))
    owners, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order]
