"""Order min-hash against a plain restatement, and the edited texts against plain Python."""

import hashlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import orderhash
from ledgerloom.llm.text import hashes, mix

MASK = 2**64 - 1


def plain(text):
    """The fingerprint of one short-worded text, written as loops."""
    words = [w for w in text.split() if w]
    symbol = [int(x) for x in hashes(pa.array(words, pa.string()))] if words else []
    end = int(orderhash._END)
    seen, numbered = {}, []
    for i in range(len(symbol)):
        key = 0
        for k in range(orderhash.SIZE):
            key = (key * 0x9E3779B97F4A7C15 + (symbol[i + k] if i + k < len(symbol) else end)) & MASK
        n = seen[key] = seen.get(key, -1) + 1
        numbered.append(int(mix(np.array([(key + n * 0xD6E8FEB86659FD93) & MASK], np.uint64))[0]))
    out = []
    for mask, factor in orderhash._FACTORS.tolist():
        rank = {}
        for at, value in enumerate(numbered):
            v = ((value ^ mask) * factor) & MASK
            rank[at] = v ^ (v >> 32)
        picked = sorted(sorted(rank, key=rank.get)[: orderhash.TUPLE])
        hash_ = 0
        for at in [*[None] * (orderhash.TUPLE - len(picked)), *picked]:
            step = (hash_ * 0x9E3779B97F4A7C15 + (end if at is None else numbered[at])) & MASK
            hash_ = int(mix(np.array([step], np.uint64))[0])
        out.append(hash_ >> 32 if numbered else 0)
    return out


def test_fingerprints_equal_plain_loops():
    texts = ["a b a b a b c", "x", "", "one two three one two three one", "b a"]
    assert orderhash.fingerprints(pa.array(texts)).tolist() == [plain(t) for t in texts]


def test_order_matters():
    words = [f"w{i}" for i in range(200)]
    same, moved = " ".join(words), " ".join(words[100:] + words[:100])
    a, b, c = orderhash.fingerprints(pa.array([same, moved, same + " more"]))
    assert (a == c).mean() > 0.9 > (a == b).mean()


def check(spark, rows, chars):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, range string").repartition(3)
    old, orderhash.RANGE_CHARS = orderhash.RANGE_CHARS, chars
    try:
        found = orderhash.compare_with_edited(frame).collect()
    finally:
        orderhash.RANGE_CHARS = old
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = orderhash.as_text(orderhash.fingerprints(pa.array([t, edited, after])))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in found)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_edited_texts(spark):
    rows = [(i * 3 % 50, f"täxt {i} " * (i % 7)) for i in range(50)] + [(None, "no id"), (7, None), (7, "again"), (100, "long words " + "x" * 500)]
    check(spark, rows, 60)
    check(spark, rows, 1 << 20)
    check(spark, [(5, "alone it is")], 10)
    check(spark, [], 10)
