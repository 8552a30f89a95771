"""BPE against the public library, both folds, the heap for long pieces, and the round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm.tokenfiles import load_ranks

RANKS = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = ["", None, "Hello world's  end\n\n x", "thouoner ingwh" * 40, "ßéñ 漢字 🙂\t\tzz", "a" * 700, " ", "12345 6789!!!", "reha thation " * 3000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encode_and_decode(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, TEXTS[2]])] + [(None, "no id", 1)], "doc_id long, text string, ids int")
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).withColumn("bytes", bpe.decode(F.col("ids"), RANKS)).collect()
    want = {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate([*TEXTS, TEXTS[2]])} | {None: (library.encode_ordinary("no id"), b"no id")}
    assert {r.doc_id: (r.ids, bytes(r.bytes)) for r in found} == want
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_folds_agree(spark, library):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdefgh th éo") for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [" thouoner", "x"]
    want = [library._encode_single_piece(p) for p in pieces]
    flat, sizes = bpe.Merges(RANKS).fold([p.encode() for p in pieces])
    rest = flat.tolist()
    assert [[rest.pop(0) for _ in range(n)] for n in sizes] == want
    assert [bpe.merge_long(p.encode(), RANKS) for p in pieces] == want
    frame = spark.createDataFrame(list(enumerate(pieces)), "i long, piece string")
    assert [r.ids for r in bpe.fold_expression(frame, RANKS).sort("i").collect()] == want


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r for r in bpe.op10_byte_bpe(spark, sf).collect()}
    assert {i: (r.n_tokens, r.ids_sha256) for i, r in found.items()} == {
        i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()}
