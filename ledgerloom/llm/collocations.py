"""Phrase collocations, mined by partitioning (SON).

Texts are cut at punctuation into pieces and those at blanks into words; everything is
counted by language. ``encode`` writes the words once as integer codes, a row for each slice
of text and language, and deals the slices to ``SHARDS`` shards. A shard is a share of the
corpus, not a task: it is mined by as many tasks as it has slices.

1. Each shard is mined completely. A phrase that occurs ``support`` times in a language
   occurs ``support * (words of the shard / words of the language)`` times, rounded up, in at
   least one shard, so that is the support asked there. Phrases are mined by length; one of
   ``k`` words is counted only if both its parts of ``k - 1`` words are frequent somewhere.
   Here phrases are hashes with the shard in their lowest bits: two that collide make a
   candidate more, never less. What is summed is the share of the support asked, so that
   one number a phrase goes through the shuffle.
2. The union of what is frequent in some shard becomes a bit map of fixed size at most.
   A map that fills up lets more phrases through, it loses none.
3. All candidates are counted over all shards, as words, exactly; those below ``support`` go.

A phrase's parts occur at least as often as the phrase, so their counts are there as well.
Slices count each distinct phrase once before anything is moved. The first ``top`` phrases of
a language are picked in salted groups first, so that one language may hold all phrases.

Null texts are empty, a null language is ``und``. Texts without words, and an empty table,
give no phrases. Repeated rows count as often as they occur. A long text is a slice of its
own. Ties are ordered by the phrase, byte by byte. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.steps import materialize
from ledgerloom.llm.text import filled, hashes, mix, ngrams, raw, slices

MAX_WORDS, SUPPORT, COVERED_PERCENT, TOP = 3, 10, 50, 2000
#: Shares of the corpus that are mined apart. More of them ask for less in each.
SHARDS = 3
#: Bits of a candidate map, at most; a smaller corpus gets a smaller one.
MAP_BITS = 1 << 28
#: Bits of a piece of the map, and phrases ranked in one group, on average.
PIECE_BITS, GROUP_ROWS = 1 << 16, 2_000_000
#: Text bytes of a slice, and what the support of a shard counts as.
PHRASE_BYTES, WHOLE = 2 << 20, 1 << 32

_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of the words of all texts, the distinct words, the text of each word, and whether it opens a piece."""
    data, offsets = raw(texts)
    kind = _KIND[data]
    is_word = kind == _WORD
    text_starts = np.zeros(len(data) + 1, bool)
    text_starts[offsets[:-1]] = True
    opens_word = is_word.copy()
    opens_word[1:] &= ~is_word[:-1] | text_starts[1:-1]
    at = np.flatnonzero(opens_word)
    # The bytes of words alone, one word after another, are a string array as they stand.
    ends = np.append(np.concatenate([[0], np.cumsum(is_word)])[at], is_word.sum()).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[is_word]]))
    coded = strings.dictionary_encode()
    owner = np.searchsorted(offsets, at, side="right") - 1
    piece = np.cumsum(kind == _STOP)[at] + owner if len(at) else at
    opens = np.ones(len(at), bool)
    opens[1:] = piece[1:] != piece[:-1]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.cast(pa.string()), owner, opens


def encode(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each slice and language: (lang, shard, n, words, codes, opens), the last three compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        small = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, limit=PHRASE_BYTES):
            codes, distinct, owner, opens = split(filled(batch, "text"))
            langs = batch.column("lang").dictionary_encode()
            of_word = langs.indices.to_numpy(zero_copy_only=False)[owner]
            order = np.argsort(of_word, kind="stable")
            present, first = np.unique(of_word[order], return_index=True)
            for lang, mine in zip(present, np.split(order, first[1:]), strict=False):
                used, code = np.unique(codes[mine], return_inverse=True)
                own = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), distinct.take(pa.array(used))), " ")[0].as_py()
                parts = [small.compress(x) for x in (own.encode(), code.astype(np.int32).tobytes(), np.packbits(opens[mine]).tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs.dictionary[int(lang)].as_py()]), pa.array([shard], pa.int32()), pa.array([len(mine)], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)],
                    ["lang", "shard", "n", "words", "codes", "opens"])

    whole = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return whole.mapInArrow(run, "lang string, shard int, n long, words binary, codes binary, opens binary")


class Block:
    """The words of one slice in one language."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        self.lang = row["lang"]
        # Words have no blanks in them.
        self.words = pc.split_pattern(pa.scalar(unpack(row["words"]).decode()), " ").values
        self.codes = np.frombuffer(unpack(row["codes"]), np.int32)
        self.opens = np.unpackbits(np.frombuffer(unpack(row["opens"]), np.uint8), count=len(self.codes)).astype(bool)
        self._salt = hashes(pa.array([self.lang]), 1)[0]
        self._symbols = hashes(self.words)[self.codes]

    def keys(self, size: int) -> np.ndarray:
        """A hash of the language and the ``size`` words from each place on."""
        return mix(ngrams(self._symbols, size) ^ self._salt)

    def inside(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each place on are in one piece."""
        out = np.ones(max(len(self.codes) - size + 1, 0), bool)
        for k in range(1, size):
            out &= ~self.opens[k : k + len(out)]
        return out

    def counted(self, places: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases at these places, by their words, and how often each is there."""
        same = self.codes[places].astype(np.int64)
        for k in range(1, size):
            same = np.unique(same * len(self.words) + self.codes[places + k], return_inverse=True)[1]
        _, first, counts = np.unique(same, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.codes[places[first] + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]), counts


def bit_map(keys: DataFrame, limit: int = MAP_BITS) -> np.ndarray:
    """A bit map of the hashes in column ``key``, with 16 bits for each or ``limit`` in all."""
    bits = int(min(limit, max(PIECE_BITS, 1 << int(16 * keys.count()).bit_length())))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out = None, np.zeros(PIECE_BITS, bool)
        for batch in batches:
            places = batch.column("place").to_numpy()
            if len(places):
                piece = int(places[0] // PIECE_BITS)
                out[places % PIECE_BITS] = True
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    places = keys.select(F.expr(f"key & {bits - 1}L").alias("place")).distinct()
    pieces = places.groupBy(F.expr(f"place div {PIECE_BITS}")).applyInArrow(fill, "piece long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    # As many rows as the map has pieces, however many phrases there are.
    for row in pieces.toArrow().to_pylist():
        out[row["piece"] * PIECE_BITS // 8 : (row["piece"] + 1) * PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _by_block(work: Callable[[Block, dict], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from work(Block(row), row)

    return run


def count_phrases(docs: DataFrame, max_words: int = MAX_WORDS, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of up to ``max_words`` words that occurs ``support`` times, and (lang, n)."""
    sc = docs.sparkSession.sparkContext
    blocks = materialize(encode(docs, shards), "phrase-blocks")
    of_lang = W.partitionBy("lang")
    shares = blocks.groupBy("lang", "shard").agg(F.sum("n").alias("own")).withColumn("n", F.sum("own").over(of_lang))
    # ceil(support * own / n) in whole numbers; the shares of a language's shards sum to one.
    asked = F.expr(f"cast((cast({support} as decimal(20,0)) * own + n - 1) div n as long)")
    shares = materialize(shares.select("lang", "shard", "n", asked.alias("need")), "phrase-shares")
    known = blocks.drop("n").join(shares.drop("n"), ["lang", "shard"])
    low = (shards - 1).bit_length()
    maps: dict[int, object] = {}

    def candidates(block: Block, size: int) -> np.ndarray:
        """Places where phrases of ``size`` words start whose parts are frequent in some shard."""
        good = block.inside(size)
        if size > 1:
            part = _holds(maps[size - 1].value, block.keys(size - 1))
            good &= part[:-1] & part[1:]
        return np.flatnonzero(good)

    for size in range(1, max_words + 1):

        def mine(block: Block, row: dict, size: int = size) -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(block.keys(size)[candidates(block, size)], return_counts=True)
            keys = keys << np.uint64(low) | np.uint64(row["shard"])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts * -(-WHOLE // row["need"]))], ["key", "share"])

        counted = known.mapInArrow(_by_block(mine), "key long, share long").groupBy("key").agg(F.sum("share").alias("share"))
        frequent = counted.filter(F.col("share") >= WHOLE).select(F.shiftrightunsigned("key", low).alias("key"))
        maps[size] = sc.broadcast(bit_map(materialize(frequent, f"frequent-{size}")))

    def count(block: Block, _: dict) -> Iterator[pa.RecordBatch]:
        for size in range(1, max_words + 1):
            places = candidates(block, size)
            phrases, counts = block.counted(places[_holds(maps[size].value, block.keys(size)[places])], size)
            lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), np.int32)), pa.array([block.lang])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, phrases, pa.array(np.full(len(counts), size), pa.int32()), pa.array(counts)], ["lang", "phrase", "size", "n"])

    found = blocks.mapInArrow(_by_block(count), "lang string, phrase string, size int, n long")
    whole = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    return materialize(whole, "phrases"), shares.groupBy("lang").agg(F.max("n").alias("n"))


def score_phrases(phrases: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score, k) of phrases of two words and more that no longer one covers."""
    full = phrases.filter("size > 1").select("lang", "phrase", F.split("phrase", " ").alias("words"), "size", F.col("f").alias("a"))
    cuts = full.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("left"),
                       F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("right"))
    counts = phrases.select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(20,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every run of two words or more inside a longer phrase, without the phrase itself.
    runs = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    longer = full.filter("size > 2").select("lang", F.explode(runs).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    covered = F.coalesce(F.col("outer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered_percent, F.lit(False))
    left = best.join(longer, ["lang", "phrase"], "left").filter(~covered)
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")


def top_phrases(scored: DataFrame, top: int = TOP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The first ``top`` phrases of each language with their rank."""
    scored = materialize(scored, "scored")
    groups = 1 + scored.count() // group_rows
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, support: int = SUPPORT, covered_percent: int = COVERED_PERCENT,
                 top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (text, lang)."""
    phrases, totals = count_phrases(docs, max_words, support, shards)
    ranked = top_phrases(score_phrases(phrases, covered_percent), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
