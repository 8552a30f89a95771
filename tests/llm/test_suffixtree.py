"""The suffix tree against one built from plain counts of tuples."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import suffixtree as st


def brute(docs, depth):
    texts = [(i, h, (t or "").lower().split() + [None]) for i, t, h in docs]
    train = [k for _, h, k in texts if not h]
    unigram = Counter(w for k in train for w in k)
    total, kinds = sum(unigram.values()), len(unigram)

    def root(w):
        return (unigram[w] + 1) / (total + kinds + 1)

    def history(tokens, i, level):
        full = [None, *tokens[:i]]
        return tuple(full[-level:]) if len(full) >= level else None

    nexts = defaultdict(Counter)
    for k in train:
        for i, w in enumerate(k):
            for level in range(1, depth + 1):
                if (c := history(k, i, level)) is not None:
                    nexts[c][w] += 1
    states = {}

    def chance(context, w):
        p = root(w)
        for level in range(1, len(context) + 1):
            c = context[-level:]
            if c in states:
                n, left, listed = states[c]
                p = max(listed.get(w, 0) - st.DISCOUNT, 0) / n + left * p
        return p

    candidates = {(): True}
    for level in range(1, depth + 1):
        for c in sorted((c for c in nexts if len(c) == level), key=repr):
            n = sum(nexts[c].values())
            # A candidate's own words must have been listed below the shorter context.
            if n < st.LEAST_CONTEXT or (level > 1 and nexts.get(c[:-1], {}).get(c[-1], 0) < st.LEAST_CONTEXT):
                continue
            listed = {w: k for w, k in nexts[c].items() if k >= st.LEAST_NEXT}
            if not listed:
                continue
            above = {w: chance(c[1:], w) for w in listed}
            gain = sum(k * math.log(k / n / above[w]) for w, k in listed.items())
            rest = n - sum(listed.values())
            if rest:
                gain += rest * math.log(rest / n / max(1 - sum(above.values()), 1e-9))
            if gain > 0.5 * math.log(max(total, 2)) * (len(listed) + 1):
                candidates[c] = True
                states[c] = (n, (rest + st.DISCOUNT * len(listed)) / n, listed)
    out = {}
    for i, h, k in texts:
        p = sum(math.log10(chance(history(k, j, min(depth, j + 1)) or (), w)) for j, w in enumerate(k))
        out[i] = (h, len(k), sum(unigram[w] > 0 for w in k), total, sum(math.log10(root(w)) for w in k), p)
    return out, len(states)


def test_against_plain_counts(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    passages = [" ".join(rng.choices(words, k=12)) for _ in range(4)]
    docs = [(i, " ".join(rng.choice([*passages, " ".join(rng.choices(words, k=8))]) for _ in range(rng.randrange(0, 6))).title(), i % 7 == 2) for i in range(80)]
    docs += [(100, None, False), (101, "", True), (102, "never\tseen " * 30, True), (103, passages[0] * 400, False)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, held_out boolean, block string").repartition(3)
    want, states = brute(docs, 3)
    assert states > 10
    found = {r.doc_id: r for r in st.score(frame).collect()}
    assert set(found) == set(want)
    for i, (held, n, known, total, base, p) in want.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - p) < 1e-3 * max(1, -p)


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = st.score(frame.withColumn("held_out", F.lit(True))).collect()
    assert len(none) == 3 and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert st.score(frame.withColumn("held_out", F.lit(False)).limit(0)).count() == 0


def test_query_beats_the_base(spark):
    rows = st.op1_suffix_tree(spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_first_places():
    inverse = np.random.default_rng(3).permutation(np.append(np.arange(50), np.random.default_rng(5).integers(0, 50, 400)))
    assert (st._first(inverse, 50) == np.unique(inverse, return_index=True)[1]).all()
