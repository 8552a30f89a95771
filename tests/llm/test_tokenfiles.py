"""Token files: counts against the encoder, for any block size, and files of other tools."""

import public_tokenizers
import numpy as np
import tiktoken

from ledgerloom.llm import tokenfiles as tf

RANKS = tf.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_round_trip(spark, docs_of, tmp_path):
    library = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = [(0, "one two"), (-5, "minus"), (None, "no id"), (7, None), (8, ""), (2**62, "long text " * 2000), (9, "again"), (9, "again"), *[(100 + i, "x " * i) for i in range(30)]]
    path = f"file:{tmp_path}/tokens"
    tf.write_token_files(docs_of(rows, "tokens string").repartition(3), path, RANKS, public_tokenizers.PATTERN)
    want = sorted(((i, len(library.encode_ordinary(t or ""))) for i, t in rows), key=repr)
    for block in (16, 100, 1 << 20):
        found = tf.count_tokens(tf.read_blocks(spark, path, block), block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == want and all(r.closed for r in found)


def test_foreign_file_without_headers(spark, tmp_path):
    (tmp_path / "part-0.bin").write_bytes(np.array([5, 6, tf.END, tf.END, 7, 8, 9, tf.END, 1, 2], "<u2").tobytes())
    (tmp_path / "part-1.bin").write_bytes(b"")
    for block in (2, 6, 100):
        found = tf.count_tokens(tf.read_blocks(spark, f"file:{tmp_path}", block), header=False, block_bytes=block).collect()
        assert sorted((r.n_tokens, r.closed) for r in found) == [(0, True), (2, False), (2, True), (3, True)]


def test_empty(spark, docs_of, tmp_path):
    path = f"file:{tmp_path}/none"
    tf.write_token_files(docs_of([]), path, RANKS, public_tokenizers.PATTERN)
    assert tf.count_tokens(tf.read_blocks(spark, path)).count() == 0
