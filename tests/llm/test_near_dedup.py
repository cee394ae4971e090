"""A large group of near copies with outliers: components equal brute force, without a pair for every two members."""

import random

import numpy as np

from docspark.llm import simhash


def test_group_with_outliers(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(250):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            t[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if root[i] != root[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert 10 < len(set(root)) < 240
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.id: r.component for r in simhash.jaccard_components(df, "doc_id", "text").collect()} == dict(enumerate(root))


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(rng.integers(0, 1 << 63, 400) if k % 5 == 0 else np.arange(0, 4000, 20), rng.integers(1, 180)).astype(np.uint64)) for k in range(120)]
    sets += [sets[3][:-1], sets[5], sets[8][2:], np.empty(0, np.uint64)]
    for similarity in (0.3, 0.8):
        i, j = simhash._similar(sets[:70], sets[40:], similarity)
        want = set()
        for a, x in enumerate(sets[:70]):
            for b, y in enumerate(sets[40:]):
                both = len(np.intersect1d(x, y))
                if both >= similarity * (len(x) + len(y) - both):
                    want.add((a, b))
        assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= 30


def test_small_tiles_give_the_same(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([2, 3, 4, 5])):
            t[rng.randrange(120)] = f"w{rng.randrange(400)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {r.id: r.component for r in simhash.jaccard_components(df, "doc_id", "text").collect()}
    assert 1 < len(set(want.values())) < 150
    simhash.TILE_ROWS, kept = 7, simhash.TILE_ROWS
    try:
        assert {r.id: r.component for r in simhash.jaccard_components(df, "doc_id", "text").collect()} == want
    finally:
        simhash.TILE_ROWS = kept
