"""Substring dedup against a direct marking of repeated windows."""

import hashlib
import random

from ledgerloom.llm import relative


def brute(docs):
    places = {}
    split = [(i, t, [w for w in (t or "").replace("\n", " ").split(" ") if w]) for i, t in docs]
    for i, _, words in split:
        for s in range(len(words) - relative.WINDOW + 1):
            places.setdefault(tuple(words[s : s + relative.WINDOW]), []).append((i if i is not None else -(2**63), s))
    out = []
    for i, _, words in split:
        gone = set()
        for s in range(len(words) - relative.WINDOW + 1):
            if min(places[tuple(words[s : s + relative.WINDOW])]) < (i if i is not None else -(2**63), s):
                gone.update(range(s, s + relative.WINDOW))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(15, 60))) for _ in range(5)]
    docs = [(None, passages[0]), (-3, passages[0] + " x " + passages[1])]
    for i in range(40):
        docs.append((i, "\n".join(rng.choice([*passages, " ".join(rng.choices(words, k=20))]) for _ in range(rng.randrange(0, 5)))))
    docs += [(50, None), (51, ""), (52, "a a a a " * 30), (53, "short text"), (7000, passages[2] + " tail " * 3000), (7001, passages[2] + " tail " * 3000)]
    docs += [docs[8]]
    frame = docs_of(docs, "spans string").repartition(4)
    old, relative.SHARE_WORDS = relative.SHARE_WORDS, 500
    try:
        found = relative.cut_repeats(frame).collect()
    finally:
        relative.SHARE_WORDS = old
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found))) == sorted(map(repr, brute(docs)))
    assert relative.cut_repeats(docs_of([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(docs))
    assert sorted(map(tuple, relative.op8_substring_dedup(spark, sf).collect())) == want
