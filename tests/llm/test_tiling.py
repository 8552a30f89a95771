"""Tiling against a direct search for common runs, and the edge rows."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import tiling


def brute_tiles(run, item, least):
    """Longest unmarked common runs, one by one, by comparing every pair of starts."""
    free = [[True] * len(run), [True] * len(item)]
    marked = []
    while True:
        best = (0, 0, 0)
        for i in range(len(run)):
            for j in range(len(item)):
                n = 0
                while i + n < len(run) and j + n < len(item) and run[i + n] == item[j + n] and free[0][i + n] and free[1][j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(1, least):
            return marked
        free[0][i : i + n] = free[1][j : j + n] = [False] * n
        marked.append((0, i, j, n))


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))], np.uint64)
        run = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], np.uint64)
        assert tiling.tiles([run], item, 3) == brute_tiles(run.tolist(), item.tolist(), 3)


def test_leaks(spark, docs_of):
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(words)
    reordered = " ".join(words[20:] + ["x"] + words[:20])
    docs = docs_of([(1, "a b c. " + passage.upper() + " d"), (2, reordered), (3, " ".join(words[:12])), (4, None), (5, ""),
                    (6, " ".join(words[::-1])), (7, passage), (7, passage), (None, passage), (8, "other words " * 3000 + passage)])
    items = spark.createDataFrame([(0, passage, 1), (1, passage, 1), (2, "three word item", 1), (3, None, 1), (4, "", 1)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r for r in tiling.leaks(docs, items).collect()}
    assert set(found) == {(i, k) for i in (1, 2, 7, 8, None) for k in (0, 1)}
    assert found[2, 0].covered == 40 and len(found[2, 0].tiles) == 2
    short = tiling.leaks(docs_of([(1, "it has a Three-word item!")]), items).collect()
    assert [(r.doc_id, r.item_id) for r in short] == [(1, 2)]


def test_empty(spark, docs_of):
    items = spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string")
    assert tiling.leaks(docs_of([]), items).count() == 0
    assert tiling.leaks(docs_of([(1, "a b c d e f")]), items.limit(0)).count() == 0


def test_words():
    symbols, starts = tiling.word_hashes(pa.array(["Ab, c", "", "ab c!"]))
    assert starts.tolist() == [0, 2, 2, 4] and (symbols[:2] == symbols[2:]).all()
