"""Mined phrases against a plain count of every run of words."""

import random
import re
from collections import Counter

import pytest

from ledgerloom.llm.collocations import collocations, encode, op11_collocations

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_force(rows, max_words, support, percent, top):
    counts = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                for i in range(len(found) - k + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(found[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = [p for p, c in f.items() if len(p) > 1 and c >= support]
        kept = []
        for p in cand:
            a = f[p]
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * f[q] >= percent * a for q in around):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def made(seed, n, langs=("en", "fr", None)):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "new", "York", "city", "été", "naïve", "x1", " ", "the"]
    weights = [rng.random() + 0.05 for _ in vocabulary]
    joints = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", ";", "\x0b"]
    texts = []
    for _ in range(n):
        bits = rng.choices(vocabulary, weights, k=rng.randrange(25))
        texts.append(("".join(w + rng.choice(joints) for w in bits), rng.choice(langs)))
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")


@pytest.mark.parametrize("seed,max_words,support,shards", [(1, 3, 4, 3), (2, 3, 2, 5), (3, 4, 5, 2), (4, 2, 3, 1)])
def test_equal_to_a_plain_count(spark, seed, max_words, support, shards):
    rows = made(seed, 200) + [(None, "en"), ("", "fr"), ("  ,.", None), ("New York city " * 40, "en")] + [("one and the same text", "fr")] * 60
    found = collocations(frame(spark, rows).repartition(7), max_words, support, 50, 12, shards)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, max_words, support, 50, 12)


def test_query(spark, tmp_path):
    rows = made(9, 900)
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_collocations(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, 3, 10, 50, 2000)
    assert dict(found.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def test_no_phrases(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("", "en"), ("word", "en")])).collect() == []


def test_one_text_far_longer_than_a_slice(spark):
    rows = [("red green blue. " * 600_000, "en"), ("red green", "en")]
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"]) for r in collocations(frame(spark, rows)).collect()}
    assert got == {"red green blue": (600_000, 600_001, 600_000, 1_800_002)}
    assert encode(frame(spark, rows)).select("n").groupBy().sum().first()[0] == 1_800_002
