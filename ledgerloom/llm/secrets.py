"""Secret scan: three fixed patterns, and novelty by dictionary-primed zstandard.

The base patterns find assignments to a sensitive name, access key ids and hexadecimal
runs, leftmost and without overlap, each kind for itself; a match that is too short is
dropped, and has still used up its characters.

What they miss is found by novelty. A candidate is a run of key characters, at least
``LEAST_RUN`` long with a letter and a digit, that starts at most ``REACH`` characters after
a sensitive word on its line. Its marginal size is what it adds to the compressed size of
the text around it, where the compressor is primed with the identifiers that are most
frequent in the whole corpus. A name that is in the dictionary, or stands nearby already,
costs a few bytes; a random key costs nearly all of its own. Candidates that cost at least
``NOVELTY`` of their length are reported as ``novel``, unless they overlap a base match.

The dictionary has ``DICTIONARY_WORDS`` words of letters and underscores, 4 to 32 long,
counted over all texts; keys with digits are never in it, however often they are copied.

A null text is empty and has no spans; so has an empty one. A long text is scanned whole.
Places count code points, ends are exclusive. Each row is judged by itself, whatever its
doc_id, so repeated rows have equal spans; novelty rests on the corpus too. A null doc_id
stays null. An empty table returns no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.steps import materialize
from ledgerloom.llm.text import filled, slices, words

# The base patterns in the order of their kinds, and the least length of a match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
# End of fixed values.

KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|signature"
RUN = r"[A-Za-z0-9+/_=.~-]+"
LEAST_RUN, REACH, NOVELTY = 12, 64, 0.7
#: Characters around a candidate that are compressed with it.
BEFORE, AFTER = 256, 64
DICTIONARY_WORDS, LEVEL = 4096, 3

_SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])


def identifiers(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` most frequent identifiers of all texts, the most frequent last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # Runs stay whole, so that the letters of a key with digits or signs are no identifier.
            split = words(pc.replace_substring_regex(filled(batch, "text"), r"[^A-Za-z0-9+/_=~-]+", " "))
            fits = np.flatnonzero(pc.match_substring_regex(split.distinct, "^[A-Za-z_]{4,32}$").to_numpy(zero_copy_only=False))
            counts = np.bincount(split.codes, minlength=len(split.distinct))
            yield pa.RecordBatch.from_arrays([split.distinct.take(pa.array(fits)), pa.array(counts[fits])], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Eighths of a power of two, some hundreds at most, tell from which count on there are enough words:
    # otherwise every task would send its own first ``size`` words to the driver.
    counted = materialize(counted.withColumn("step", F.floor(F.log2("n") * 8)), "identifiers")
    enough, least = 0, 0
    for row in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
        enough, least = enough + row["count"], row["step"]
        if enough >= size:
            break
    return [r["word"] for r in counted.filter(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(size).collect()][::-1]


class Novelty:
    """Marginal compressed sizes under a dictionary."""

    def __init__(self, dictionary: list[str]) -> None:
        primed = zstandard.ZstdCompressionDict(" ".join(dictionary).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        if primed:
            primed.precompute_compress(level=LEVEL)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode()))

    def of(self, before: str, candidate: str, after: str) -> float:
        """What the candidate adds to the compressed size of its surroundings, as a share of its own size."""
        return max(0, self.size(before + candidate + after) - self.size(before + after)) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the matches of the base patterns, in their order."""
    # A short match of the first pattern uses up what a longer one may start in, so its length is judged after matching;
    # runs of the others are matched to their ends, where asking for the length at once is the same.
    found = [(0, *m.span()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= LEAST_ASSIGN]
    found += [(1, *m.span()) for m in re.finditer(f"{ACCESS[:-1]}{{{LEAST_ACCESS - 4},}}", text)]
    found += [(2, *m.span()) for m in re.finditer(f"{HEX[:-1]}{{{LEAST_HEX},}}", text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters after a sensitive word; each character is looked at in one candidate at most."""
    run, taken = re.compile(RUN), 0
    for hit in re.finditer(SENSITIVE, text, re.IGNORECASE | re.ASCII):
        if hit.end() < taken:
            continue
        line = text.find("\n", hit.end(), hit.end() + REACH)
        for near in run.finditer(text, max(hit.end(), taken), line if line >= 0 else hit.end() + REACH):
            if near.start() < taken:
                continue
            start, taken = run.match(text, near.start()).span()
            if taken - start >= LEAST_RUN and re.search("[0-9]", found := text[start:taken]) and re.search("[A-Za-z]", found):
                yield start, taken


def all_spans(text: str, novelty: Novelty) -> list[tuple[int, int, int, float | None]]:
    base = base_spans(text)
    # The base spans' union, by start, to ask whether a candidate meets one.
    starts = np.array([s for _, s, _ in base], np.int64)
    ends = np.maximum.accumulate(np.array([e for *_, e in base], np.int64)) if base else starts
    found: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base]
    for start, end in candidates(text):
        before_end = int(np.searchsorted(starts, end))
        if before_end and ends[before_end - 1] > start:
            continue
        share = novelty.of(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER])
        if share >= NOVELTY:
            found.append((3, start, end, share))
    return sorted(found, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    """(doc_id, spans) for each row; a span is (kind, start, end, novelty), the last only for novel ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Texts in which nothing of this stands have no span.
    worth = rf"(?i:{SENSITIVE})|AKIA|[0-9a-f]{{{LEAST_HEX}}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in slices(batches):
            texts = filled(batch, "text")
            hit = pc.match_substring_regex(texts, worth).to_numpy(zero_copy_only=False)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "novelty": n} for k, a, b, n in all_spans(texts[i].as_py(), novelty)] if hit[i] else []
                    for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_STRUCT))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {_SPANS}")


def _of(kind: str) -> F.Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, identifiers(docs))
    counts = [F.size(_of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = _joined(F.filter("spans", lambda s: s["kind"] != KINDS[3]))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
