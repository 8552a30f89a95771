"""The forest join against exact Jaccard over all pairs."""

import random

from ledgerloom.llm import forest


def shingle_set(text):
    words = (text or "").lower().split()
    size = min(forest.SIZE, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(docs):
    texts = sorted({t or "" for _, t in docs})
    sets = {t: shingle_set(t) for t in texts}
    links = {t: 0 for t in texts}
    group = {t: t for t in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared / (len(sets[a]) + len(sets[b]) - shared) >= forest.SIMILARITY:
                links[a] += 1
                links[b] += 1
                group[root(a)] = root(b)
    name = {}
    for i, t in docs:
        mine = (i is not None, i or 0)
        name[root(t or "")] = min(name.get(root(t or ""), mine), mine)
    texts_of = [t or "" for _, t in docs]
    return [(i, name[root(t or "")][1] if name[root(t or "")][0] else None, links[t or ""], texts_of.count(t or "")) for i, t in docs]


def edited(rng, text, words, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def test_against_all_pairs(spark, docs_of):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(8)]
    docs = [(i, edited(rng, rng.choice(base), words, rng.randrange(0, 5))) for i in range(60)]
    crowd = " ".join(rng.choices(words, k=150))
    docs += [(1000 + i, edited(rng, crowd, words, rng.randrange(0, 4))) for i in range(150)]
    docs += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two"), (2004, "one three"), (None, base[0]), docs[0], (2005, "long text " * 5000 + "end")]
    old, forest.BLOCK = forest.BLOCK, 40
    try:
        found = forest.similar_documents(docs_of(docs, "first string")).drop("text_id").collect()
    finally:
        forest.BLOCK = old
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(docs)))


def test_empty(spark, docs_of):
    assert forest.similar_documents(docs_of([])).count() == 0
    assert [tuple(r) for r in forest.similar_documents(docs_of([(1, None)])).drop("text_id").collect()] == [(1, 1, 0, 1)]
