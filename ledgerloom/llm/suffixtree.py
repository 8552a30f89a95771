"""Language-model scoring by a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words. A context is a candidate if it
occurs ``LEAST_CONTEXT`` times or more in the training texts, and is retained if its
next-word distribution diverges from that of the state above by more than it costs to
write down: the divergence over its occurrences, in nats, against half the logarithm of
the corpus size for each next word it lists. It lists the next words seen ``LEAST_NEXT``
times or more. Distributions are smoothed by absolute discounting: what a state takes
off its counts goes to the state above it, and at the root every word, unseen ones
too, has its count plus one. A word is scored by the longest retained suffix of the words
before it. The mark between texts is both a text's last token and the context of its
first word.

The corpus is written once as blocks of word codes with the words of each block. Counts
are not collected: for each level every block asks, for the distinct contexts or next
words that it holds, the task that has their range of hashes, which adds up what all
blocks sent and answers each of them. So whatever grows with the corpus is spread by
hash, a frequent word is one entry per block, and scoring reads a block and its answers.
Word counts are kept by 64-bit hashes, counts of longer runs by 40 bits within their range.

A null text has no words, just the end token. Repeated rows are texts of their own; a null doc_id is kept.
An empty table returns no rows; without training rows N and V are 0 and every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, hashes, held_out, mix, slices, words
from ledgerloom.llm.steps import Chain

DEPTH, LEAST_CONTEXT, LEAST_NEXT, DISCOUNT = 3, 4, 2, 0.75
BLOCK_BYTES = 8 << 20
#: Words whose counts one task adds up, on average.
SHARE_WORDS = 3 << 19
_END = np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _restored(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def write_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, held, counts, codes, symbols): runs of texts with the hashes of their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, limit=BLOCK_BYTES):
            split = words(filled(batch, "text"), lower=True)
            symbols = hashes(split.distinct) if len(split.distinct) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.packbits(batch.column("held_out").to_numpy(zero_copy_only=False)).tobytes()], pa.binary()),
                pa.array([_squeezed(split.counts.astype(np.int64))], pa.binary()), pa.array([_squeezed(split.codes.astype(np.int32))], pa.binary()),
                pa.array([symbols.tobytes()], pa.binary())], ["block", "doc_ids", "held", "counts", "codes", "symbols"])
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(
        run, "block long, doc_ids array<long>, held binary, counts binary, codes binary, symbols binary")


class Block:
    """The token sequence of a block: each text's words and an end mark, and what is known of every token so far."""

    def __init__(self, row: dict) -> None:
        self.row = row
        counts = _restored(row["counts"], np.int64)
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(counts)).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(counts + 1)])
        symbols = np.append(np.frombuffer(row["symbols"], np.uint64), _END)
        codes = np.full(self.starts[-1], len(symbols) - 1, np.int64)
        is_word = np.ones(self.starts[-1], bool)
        is_word[self.starts[1:] - 1] = False
        codes[is_word] = _restored(row["codes"], np.int32)
        self.symbols, self.codes = symbols, codes
        self.token = symbols[codes]
        self.owner = np.repeat(np.arange(len(counts)), counts + 1)
        self.place = np.arange(len(codes)) - self.starts[:-1][self.owner]
        self.trained = ~self.held[self.owner]

    def array(self, name: str, kind: type, size: int) -> np.ndarray:
        found = self.row.get(name)
        return _restored(found, kind) if found is not None else np.zeros(size, kind)

    @property
    def word_n(self) -> np.ndarray:
        """How often each token occurs in the training texts."""
        return self.array("word_n", np.int64, len(self.symbols))[self.codes]

    def before(self, values: np.ndarray, fill) -> np.ndarray:
        """What the token before has; ``fill`` for the first token of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts[:-1]] = fill
        return out

    def contexts(self, level: int) -> np.ndarray:
        """A hash of the ``level`` tokens before each token; a text's first context is the end mark."""
        key = np.zeros(len(self.token), np.uint64)
        last = self.token
        for _ in range(level):
            last = self.before(last, _END)
            key = mix(key * _STEP + last)
        return mix(key + np.uint64(level))


def _ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys cut into even ranges: which there are, where each starts, and 40 bits of each key's place in its range."""
    low = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(parts)
    scaled = (keys >> np.uint64(32)) * np.uint64(parts) + (low >> np.uint64(32))
    place = (scaled & np.uint64(0xFFFFFFFF)) << np.uint64(8) | (low & np.uint64(0xFFFFFFFF)) >> np.uint64(24)
    present, first = np.unique(scaled >> np.uint64(32), return_index=True)
    return present.astype(np.int64), np.append(first, len(keys)), place


def _pack(keys: np.ndarray, places: np.ndarray, wide: bool) -> bytes:
    """Whole keys, or the steps between their places, which are short numbers."""
    if wide:
        return keys.tobytes()
    steps = np.diff(places, prepend=np.uint64(0))
    return _squeezed(steps.view(np.uint8).reshape(-1, 8)[:, :5].T)


def _unpack(blob: bytes, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(blob, np.uint64)
    flat = _restored(blob, np.uint8).reshape(5, -1).T
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :5] = flat
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


Question = Callable[[Block], tuple[np.ndarray, dict[str, np.ndarray]]]
Answer = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def exchange(blocks: DataFrame, ask: Question, sent: dict[str, type], answer: Answer, got: dict[str, type], parts: int, wide: bool = False) -> DataFrame:
    """Blocks with the answers to their questions in columns ``got``.

    ``ask`` gives a block's distinct keys in ascending order and what it knows of each. ``answer`` gets the sum of that over all
    blocks by distinct key, once for every range of keys, and returns what to tell of each key.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, values = ask(Block(row))
                present, first, places = _ranges(keys, parts)
                cut = list(zip(first, first[1:], strict=False))
                blobs = [pa.array([_pack(keys[a:b], places[a:b], wide) for a, b in cut], pa.binary())]
                blobs += [pa.array([_squeezed(values[c][a:b].astype(kind)) for a, b in cut], pa.binary()) for c, kind in sent.items()]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(present), pa.int64()), pa.array(present), *blobs], ["block", "part", "keys", *sent])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        keys = [_unpack(r.pop("keys"), wide) for r in rows]
        sizes = [len(k) for k in keys]
        together = np.concatenate(keys)
        del keys
        every, inverse = np.unique(together, return_inverse=True)
        del together
        sums = {}
        # One column at a time: what the blocks sent of it is let go before the next one.
        for c, kind in sent.items():
            values = np.concatenate([_restored(r.pop(c), kind) for r in rows])
            sums[c] = np.bincount(inverse, values, len(every)) if c[0] != "=" else _last(inverse, values, len(every))
            del values
        told = answer(every, inverse, sums)
        del sums
        ends = np.cumsum(sizes)
        # The first block that sent a key owns it: it alone reports what must be counted once.
        owner = np.zeros(len(inverse), bool)
        owner[_first(inverse, len(every))] = True
        for row, size, end in zip(rows, sizes, ends, strict=True):
            mine = inverse[end - size : end]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([row["part"]], pa.int64()), *(pa.array([_squeezed(told[c][mine].astype(kind))], pa.binary()) for c, kind in got.items()),
                 pa.array([np.packbits(owner[end - size : end]).tobytes()], pa.binary()), pa.array([size], pa.int64())],
                ["block", "part", *got, "owner", "size"])

    questions = blocks.mapInArrow(send, "block long, part long, keys binary, " + ", ".join(f"`{c}` binary" for c in sent))
    answers = questions.groupBy("part").applyInArrow(reply, "block long, part long, " + ", ".join(f"{c} binary" for c in got) + ", owner binary, size long")
    together = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "size", "owner", *got))).alias("told"))
    return blocks.join(together, "block", "left")


def _last(inverse: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """A value that all blocks agree on."""
    out = np.zeros(size, values.dtype)
    out[inverse] = values
    return out


def _first(inverse: np.ndarray, size: int) -> np.ndarray:
    """Where each of ``size`` numbers stands first; all of them occur."""
    out = np.zeros(size, np.int64)
    out[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
    return out


def _told(row: dict, name: str, kind: type) -> np.ndarray:
    return np.concatenate([_restored(t[name], kind) for t in row["told"]] or [np.zeros(0, kind)]) if row["told"] else np.zeros(0, kind)


def _owned(row: dict) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(t["owner"], np.uint8), count=t["size"]).astype(bool) for t in row["told"] or []] or [np.zeros(0, bool)])


def _kept(chain: Chain, blocks: DataFrame, absorb: Callable[[Block], dict[str, np.ndarray]], old: list[str], new: list[str], label: str) -> DataFrame:
    """Blocks with columns from ``absorb`` instead of the answers, written to the shared folder."""
    base = ["block", "doc_ids", "held", "counts", "codes", "symbols"]
    names = [*base, *dict.fromkeys([*old, *new])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row |= {k: _squeezed(v) for k, v in absorb(Block(row)).items()}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], schema[n]) for n in names], names)

    schema = {n: pa.binary() for n in names} | {"block": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    text = ", ".join(f"{n} {({'block': 'long', 'doc_ids': 'array<long>'}).get(n, 'binary')}" for n in names)
    return chain.write(blocks.mapInArrow(run, text), label)


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, states) of each row of ``docs`` (doc_id, text, held_out).

    ``states`` is how many of the tokens were scored below the root.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, int(size // (6 * SHARE_WORDS)))
    chain = Chain(docs.sparkSession)
    blocks = chain.write(write_blocks(docs), "tree-blocks")

    def word_counts(block: Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        counts = np.bincount(block.codes, block.trained, len(block.symbols))
        order = np.argsort(block.symbols)
        return block.symbols[order], {"n": counts[order]}

    def count_of(block: Block) -> dict[str, np.ndarray]:
        out = np.zeros(len(block.symbols), np.int64)
        out[np.argsort(block.symbols)] = _told(block.row, "total", np.int64)
        return {"word_n": out}

    asked = exchange(blocks, word_counts, {"n": np.int64}, lambda _, __, sums: {"total": sums["n"]}, {"total": np.int64}, parts, wide=True)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total, owned = _told(row, "total", np.int64), _owned(row)
                yield pa.RecordBatch.from_arrays([pa.array([int(total[owned].sum())]), pa.array([int((total[owned] > 0).sum())])], ["n", "v"])

    asked = chain.write(asked, "tree-words")
    total, distinct = (int(x or 0) for x in asked.mapInArrow(sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    blocks = _kept(chain, asked, count_of, [], ["word_n"], "tree-0")
    cost = 0.5 * np.log(max(total, 2))

    def root(block: Block) -> np.ndarray:
        return (block.word_n.astype(np.float64) + 1) / (total + distinct + 1)

    def context_n(block: Block, level: int) -> np.ndarray:
        """How often the context of each token occurs in training; 0 if it is no candidate."""
        n = block.word_n if level == 1 else block.array(f"next_n{level - 1}", np.int32, 0)
        out = block.before(n, 0).astype(np.int64)
        if level == 1:
            # The end mark before a text occurs once for each training text.
            out[block.starts[:-1]] = n[block.starts[1:] - 1]
        return np.where((out >= LEAST_CONTEXT) & (block.place >= level - 1), out, 0)

    def chances(block: Block, level: int) -> np.ndarray:
        """The probability of each token by its longest state of up to ``level`` words."""
        chance = root(block)
        for k in range(1, level + 1):
            n, seen, left = context_n(block, k), block.array(f"next_n{k}", np.int32, 0), block.array(f"left{k}", np.float32, 0)
            state = left >= 0
            own = np.maximum(seen[state] - DISCOUNT, 0) * (seen[state] >= LEAST_NEXT) / n[state]
            chance[state] = own + left[state] * chance[state]
        return chance

    known = ["word_n"]
    for level in range(1, depth + 1):

        def pairs(block: Block, level: int = level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Candidate tokens, and their (context, next word) keys with the inverse."""
            at = np.flatnonzero((context_n(block, level) > 0) & (block.word_n >= LEAST_NEXT))
            keys, inverse = np.unique(mix(block.contexts(level)[at] * _STEP + block.token[at]), return_inverse=True)
            return at, keys, inverse

        def next_counts(block: Block, pairs=pairs) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            at, keys, inverse = pairs(block)
            return keys, {"n": np.bincount(inverse, block.trained[at], len(keys))}

        def next_of(block: Block, pairs=pairs, level: int = level) -> dict[str, np.ndarray]:
            at, keys, inverse = pairs(block)
            out, owned = np.zeros(len(block.codes), np.int32), np.zeros(len(block.codes), bool)
            out[at] = _told(block.row, "total", np.int32)[inverse]
            # One token stands for each pair that this block owns.
            owned[at[_first(inverse, len(keys))]] = _owned(block.row)
            return {f"next_n{level}": out, "owned": np.packbits(owned)}

        def contexts(block: Block, level: int = level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(context_n(block, level) > 0)
            keys, inverse = np.unique(block.contexts(level)[at], return_inverse=True)
            return at, keys, inverse

        def divergence(block: Block, contexts=contexts, level: int = level) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            at, keys, inverse = contexts(block)
            n, seen = context_n(block, level)[at], block.array(f"next_n{level}", np.int32, 0)[at]
            owned = np.unpackbits(block.array("owned", np.uint8, 0), count=len(block.codes)).astype(bool)[at] & (seen >= LEAST_NEXT)
            above = chances(block, level - 1)[at]
            gain = np.where(owned, seen * np.log(np.maximum(seen, 1) / n / above), 0)
            add = {"gain": gain, "mass": np.where(owned, above, 0), "seen": np.where(owned, seen, 0), "listed": owned}
            return keys, {c: np.bincount(inverse, v, len(keys)) for c, v in add.items()} | {"=n": _last(inverse, n, len(keys))}

        def retain(_, __, sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            n, rest = sums["=n"], np.maximum(sums["=n"] - sums["seen"], 0)
            rest_above = np.maximum(1 - sums["mass"], 1e-9)
            gain = sums["gain"] + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / n / rest_above), 0)
            left = (rest + DISCOUNT * sums["listed"]) / n
            return {"left": np.where((sums["listed"] > 0) & (gain > cost * (sums["listed"] + 1)), left, -1.0)}

        def left_of(block: Block, contexts=contexts, level: int = level) -> dict[str, np.ndarray]:
            at, _, inverse = contexts(block)
            out = np.full(len(block.codes), -1, np.float32)
            out[at] = _told(block.row, "left", np.float32)[inverse]
            return {f"left{level}": out}

        asked = exchange(blocks, next_counts, {"n": np.int32}, lambda _, __, sums: {"total": sums["n"]}, {"total": np.int32}, parts)
        blocks = _kept(chain, asked, next_of, known, [f"next_n{level}", "owned"], f"tree-{level}-next")
        asked = exchange(blocks, divergence, {"gain": np.float64, "mass": np.float64, "seen": np.int64, "listed": np.int32, "=n": np.int64}, retain, {"left": np.float32}, parts)
        known += [f"next_n{level}", f"left{level}"]
        blocks = _kept(chain, asked, left_of, known, [], f"tree-{level}")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                n = len(row["doc_ids"])
                state = np.any([block.array(f"left{k}", np.float32, 0) >= 0 for k in range(1, depth + 1)], axis=0) if depth else np.zeros(len(block.codes), bool)

                def by_text(values: np.ndarray, block: Block = block, n: int = n) -> np.ndarray:
                    return np.bincount(block.owner, values, n)

                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(block.held), pa.array(np.diff(block.starts)),
                    pa.array(by_text(block.word_n > 0).astype(np.int64)), pa.array(np.full(n, total)),
                    pa.array(by_text(np.log10(root(block)))), pa.array(by_text(np.log10(chances(block, depth)))), pa.array(by_text(state).astype(np.int64)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "states"])

    return blocks.mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, states long")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out("doc_id", 7, 2))
    return score(docs)
