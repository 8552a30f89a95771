"""Substring dedup by relative Lempel-Ziv parsing.

Every text is factored against the texts before it. A factor is a run of words that also
stands at an earlier place (a smaller doc_id, or the same text further left); the parse
is greedy, so a factor goes on for as long as the words that follow it in the reference
follow it in the text too. Factors of ``WINDOW`` words or more are duplicates. Where one
factor ends and the next begins, the windows across the boundary are looked up as well,
so no repeated window is missed for want of a single reference.

The index of reference blocks has two levels. Each window has an anchor, the least hash of
the short runs in it; equal windows have equal anchors. Blocks first send only their
distinct anchors, and those seen twice anywhere are marked in a bit map of fixed size.
Then they send the hashes of windows with a marked anchor, which meet by hash and find
their earliest place. A full map lets more windows through, it loses none.

Windows are equal if their 128-bit hashes are. A null text has no words; one of fewer
than ``WINDOW`` words has no window. A null doc_id comes before all others. Rows of the same doc_id and text
are one document, so they keep the same words; rows of one doc_id with other texts are
documents of their own in the order of a hash of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, hashes, mix, ngrams, slices, words
from ledgerloom.llm.steps import materialize

WINDOW, ANCHOR = 20, 8
#: Bits of the anchor map, at most; smaller inputs get a smaller one.
MAP_BITS = 1 << 28
#: Words whose windows one task brings together, on average.
SHARE_WORDS = 1 << 20
_LOWEST = -(2**63)


def _runs(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Places at which ``size`` words of one text begin."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    ends = np.cumsum(counts)
    return np.repeat(starts[:-1] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbouring values, by doubling."""
    width, least = 1, values
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Windows:
    """The windows of a slice of texts: place, anchor and two hashes of each."""

    def __init__(self, texts: pa.Array) -> None:
        split = words(texts)
        self.starts = split.starts
        self.words = split
        symbols = hashes(split.distinct)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
        self.at = _runs(symbols, split.starts, WINDOW)
        if len(self.at):
            self.anchors = _least_of(ngrams(symbols, ANCHOR), WINDOW - ANCHOR + 1)[self.at]
        else:
            self.anchors = np.zeros(0, np.uint64)
        self._symbols = symbols

    def sightings(self) -> np.ndarray:
        """The short runs that are the anchor of a window over them, one for each place."""
        if not len(self.at):
            return self.anchors
        runs = ngrams(self._symbols, ANCHOR)
        span = WINDOW - ANCHOR + 1
        starting = np.zeros(len(runs) + span - 1, np.uint64)
        starting[self.at + span - 1] = self.anchors
        # No anchor is over a run in its window, so the run is an anchor if the greatest one over it is the run itself.
        greatest = ~_least_of(~starting, span)
        return runs[(greatest == runs) & (greatest > 0)]

    def hashed(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows at places ``some``."""
        if not len(some):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = mix(self._symbols ^ np.uint64(0x5851F42D4C957F2D))
        return ngrams(self._symbols, WINDOW)[some], ngrams(second, WINDOW)[some]


def _uids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy(zero_copy_only=False), batch.column("uid").to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.xxhash64("doc_id", "text").alias("uid"))


def _parts(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that groups hashes into ``n`` even ranges, the ranges present, and where each starts."""
    part = ((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    present, first = np.unique(part[order], return_index=True)
    return order, present.astype(np.int64), np.append(first, len(values))


def repeated_anchors(docs: DataFrame, parts: int, bits: int) -> np.ndarray:
    """A bit map of the anchors that windows of two texts, or far windows of one, have in common."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Windows(filled(batch, "text"))
            values, counts = np.unique(found.sightings(), return_counts=True)
            _, present, first = _parts(values, parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(present), pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()),
                 pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())],
                ["part", "anchors", "twice"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, twice, part = [], [], None
        for batch in batches:
            for p, a, t in zip(*(batch.column(c).to_pylist() for c in ("part", "anchors", "twice")), strict=True):
                part = p
                values.append(np.frombuffer(a, np.uint64))
                twice.append(np.unpackbits(np.frombuffer(t, np.uint8), count=len(values[-1])).astype(bool))
        if part is not None:
            every, again = np.concatenate(values), np.concatenate(twice)
            order = np.argsort(every)
            every, again = every[order], again[order]
            again[1:] |= every[1:] == every[:-1]
            place = np.unique(_bit(every[again], bits))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.uint64(1) << (place & 63).astype(np.uint64)).cast(pa.uint64()).view(pa.int64())], ["word", "bit"])

    found = docs.select("text").mapInArrow(collect, "part long, anchors binary, twice binary")
    marks = found.groupBy("part").applyInArrow(meet, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    # The map has a fixed number of words, however many anchors there are.
    for batch in marks.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.view(np.uint8)


#: What a slice asks of a window, and what it knows of the windows that repeat within it.
_ASKED = ("one", "two", "key", "uid", "start")
_REPEATS = ("again_uid", "again_start", "again_ref_key", "again_ref_uid", "again_ref_start")


def _sightings(one: np.ndarray, two: np.ndarray, key: np.ndarray, uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sightings by window and place; in it, where the first of each one's window is, and which are later places."""
    order = np.lexsort((start, uid, key, two, one))
    one, two, uid, start = (c[order] for c in (one, two, uid, start))
    opens = np.ones(len(order), bool)
    opens[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(order) else np.zeros(0, np.int64)
    return order, first, (uid != uid[first]) | (start != start[first])


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values) & np.uint64(bits - 1)).astype(np.int64)


def factors(docs: DataFrame) -> DataFrame:
    """(key, uid, spans) for each text with duplicates; a span is (start, length, reference key, reference start)."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, int(size // (6 * SHARE_WORDS)))
    bits = int(min(MAP_BITS, max(1 << 16, 1 << int(size).bit_length())))
    keyed = _keyed(docs)
    marked = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, parts, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Windows(filled(batch, "text"))
            place = _bit(found.anchors, bits)
            hit = (marked.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            at = found.at[hit]
            one, two = found.hashed(at)
            keys, uids = _uids(batch)
            owner = np.searchsorted(found.starts, at, side="right") - 1
            key, uid, start = keys[owner], uids[owner], at - found.starts[owner]
            # Only the earliest sighting of a window in this slice has to meet the others; the rest repeat it.
            order, first, later = _sightings(one, two, key, uid, start)
            lead = order[np.unique(first)]
            one, two, mine = one[lead], two[lead], [c[lead] for c in (key, uid, start)]
            again, origin = order[later], order[first[later]]
            rest = [uid[again], start[again], key[origin], uid[origin], start[origin]]
            by_hash, to, cut = _parts(one, parts)
            asked = dict(zip(to.tolist(), zip(cut, cut[1:], strict=False), strict=True))
            by_text, home, cut = _parts(mix(rest[0].view(np.uint64)), parts)
            known = dict(zip(home.tolist(), zip(cut, cut[1:], strict=False), strict=True))
            present = sorted({*asked, *known})
            blobs = [pa.array([c[by_hash][slice(*asked.get(p, (0, 0)))].tobytes() for p in present], pa.binary()) for c in (one, two, *mine)]
            blobs += [pa.array([c[by_text][slice(*known.get(p, (0, 0)))].tobytes() for p in present], pa.binary()) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), *blobs], ["part", *_ASKED, *_REPEATS])

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [np.zeros(0, np.int64)] for c in (*_ASKED, *_REPEATS)}
        for batch in batches:
            for name, rows in held.items():
                rows.extend(np.frombuffer(b, np.int64) for b in batch.column(name).to_pylist())
        one, two, key, uid, start = (np.concatenate(held[c]) for c in _ASKED)
        order, first, later = _sightings(one, two, key, uid, start)
        again, origin = order[later], order[first[later]]
        found = (uid[again], start[again], key[origin], uid[origin], start[origin])
        uid, start, ref_key, ref_uid, ref_start = (np.concatenate([x, *held[c]]) for x, c in zip(found, _REPEATS, strict=True))
        if not len(uid):
            return
        home = (mix(uid.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        present, cut = np.unique(home[order], return_index=True)
        cut = np.append(cut, len(home))
        columns = [c[order] for c in (uid, start, ref_key, ref_uid, ref_start)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(present), *(pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for c in columns)],
            ["home", "uid", "start", "ref_key", "ref_uid", "ref_start"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [] for c in ("uid", "start", "ref_key", "ref_uid", "ref_start")}
        for batch in batches:
            for name, rows in held.items():
                rows.extend(np.frombuffer(b, np.int64) for b in batch.column(name).to_pylist())
        if not held["uid"]:
            return
        uid, start, ref_key, ref_uid, ref_start = (np.concatenate(held[c]) for c in held)
        order = np.lexsort((start, uid))
        uid, start, ref_key, ref_uid, ref_start = (c[order] for c in (uid, start, ref_key, ref_uid, ref_start))
        same = (uid[1:] == uid[:-1])
        repeat = same & (start[1:] == start[:-1])  # rows of the same document
        keep = np.append(True, ~repeat)
        uid, start, ref_key, ref_uid, ref_start = (c[keep] for c in (uid, start, ref_key, ref_uid, ref_start))
        # A factor goes on while text and reference both move on by one word.
        goes_on = (uid[1:] == uid[:-1]) & (np.diff(start) == 1) & (ref_uid[1:] == ref_uid[:-1]) & (np.diff(ref_start) == 1)
        opens = np.flatnonzero(np.append(True, ~goes_on))
        length = np.diff(np.append(opens, len(uid))) + WINDOW - 1
        texts, cut = np.unique(uid[opens], return_index=True)
        offsets = pa.array(np.append(cut, len(opens)).astype(np.int32))
        spans = pa.StructArray.from_arrays(
            [pa.array(start[opens]), pa.array(length), pa.array(ref_key[opens]), pa.array(ref_start[opens])], ["start", "length", "ref_key", "ref_start"])
        yield pa.RecordBatch.from_arrays([pa.array(texts), pa.ListArray.from_arrays(offsets, spans)], ["uid", "spans"])

    blobs = keyed.mapInArrow(candidates, "part long, " + ", ".join(f"{c} binary" for c in (*_ASKED, *_REPEATS)))
    met = blobs.groupBy("part").applyInArrow(earliest, "home long, uid binary, start binary, ref_key binary, ref_uid binary, ref_start binary")
    return met.groupBy("home").applyInArrow(parse, "uid long, spans array<struct<start:long,length:long,ref_key:long,ref_start:long>>")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): ``kept`` is the text's words outside its factors, parted by spaces."""
    found = materialize(factors(docs), "factors")
    joined = _keyed(docs).select("doc_id", "text", "uid").join(found, "uid", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = "array<struct<start:long,length:long,ref_key:long,ref_start:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = words(filled(batch, "text"))
            spans = batch.column("spans")
            sizes = np.array([len(x) if x is not None else 0 for x in spans.to_pylist()])
            flat = pa.concat_arrays([spans]).flatten() if len(spans) else spans.flatten()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            begin = split.starts[owner] + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            end = begin + flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.bincount(begin, minlength=len(split.codes) + 1) - np.bincount(end, minlength=len(split.codes) + 1)
            stay = np.cumsum(change)[: len(split.codes)] == 0
            kept = split.distinct.take(pa.array(split.codes[stay])).to_pylist()
            left = np.concatenate([[0], np.cumsum(stay)])[split.starts]
            texts = [" ".join(kept[a:b]) for a, b in zip(left, left[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(split.counts), pa.array(split.counts - np.diff(left)), pa.array(texts, pa.string()), spans],
                ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string, spans {spans_type}")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
