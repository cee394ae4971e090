"""Recall of the seeds under random edits, and items of any length."""

import numpy as np

from docspark.llm import decontaminate as D


def edited(item, rng, rate, indels):
    out = []
    for t in item:
        x = rng.random()
        if x < rate:
            out.append(int(rng.integers(1, 1 << 62)))
        elif x < rate + indels:
            continue
        else:
            out.append(int(t))
        if rng.random() < indels:
            out.append(int(rng.integers(1, 1 << 62)))
    return np.array([*rng.integers(1, 1 << 62, 30).tolist(), *out, *rng.integers(1, 1 << 62, 30).tolist()], np.uint64)


def found(item, doc):
    """Whether a seed of the item meets the document on a diagonal on which it is covered."""
    for number, mask in D.masks_for({len(item)}):
        at = {}
        for k, key in enumerate(D.seed_keys(item, mask, number).tolist()):
            at.setdefault(key, []).append(k)
        for k, key in enumerate(D.seed_keys(doc, mask, number).tolist()):
            if any(D.coverage(item, doc, k - i) >= D.SIMILARITY for i in at.get(key, ())):
                return True
    return False


def test_recall_of_seeds():
    """Substitutions never hide an item that is covered; with insertions and losses 98 % are found."""
    rng = np.random.default_rng(6)
    for indels in (0.0, 0.02):
        held = hit = 0
        for n in (8, 12, 20, 40):
            for rate in (0.05, 0.1, 0.15, 0.2):
                for _ in range(150):
                    item = rng.integers(1, 1 << 62, n).astype(np.uint64)
                    doc = edited(item, rng, rate, indels)
                    if max(D.coverage(item, doc, x) for x in range(20, 45)) >= D.SIMILARITY:
                        held += 1
                        hit += found(item, doc)
        assert held > 500
        assert hit == held if not indels else hit >= 0.98 * held


def test_marked_diagonals_only():
    """Many or few, by pairs or by correlation: the diagonals of the hits and no others are tried."""
    rng = np.random.default_rng(1)
    for n, m in ((1, 5), (3, 40), (12, 30), (60, 200), (70, 3)):
        item, doc = rng.integers(1, 4, n).astype(np.uint64), rng.integers(1, 4, m).astype(np.uint64)
        for share in (0.05, 0.5, 1.0):
            hits = [{"places": np.flatnonzero(rng.random(m) < share).tolist(), "ats": np.flatnonzero(rng.random(n) < share).tolist()} for _ in range(3)]
            pairs = {p - a for h in hits for p in h["places"] for a in h["ats"]}
            assert set((np.flatnonzero(D._marked(hits, n, m)) - n).tolist()) == pairs
            if pairs:
                want = max(D.coverage(item, doc, x) for x in pairs)
                assert D.similarity_of(item, doc, hits) == want == D._best_of(item, doc, D._marked(hits, n, m))


def test_a_seed_that_repeats_tries_no_other_diagonal():
    item = np.array([1, 2] * 20, np.uint64)
    doc = np.array([1, 2] * 400, np.uint64)
    even = [{"places": list(range(0, 800, 2)), "ats": list(range(0, 40, 2))}]
    assert len(even[0]["places"]) * len(even[0]["ats"]) > 4 * (len(item) + len(doc))
    assert set((np.flatnonzero(D._marked(even, 40, 800)) - 40) % 2) == {0}
    assert D.similarity_of(item, doc, even) == 1.0


def test_items_of_any_length(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "one two"), (3, "a b c d"), (4, ""), (5, None), (6, "w " * 2_000), (7, "0, " * 30 + "end")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say ONE thing"), (2, "one, two!"), (3, "x a b c d y"), (4, None), (5, "z " + "w " * 20_000), (6, ""), (7, "0 " * 5_000)], "doc_id long, text string")
    pairs = lambda **a: {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, **a).collect()}
    assert pairs() == {(5, 6), (7, 7)}
    assert pairs(min_tokens=1) == {(1, 1), (2, 1), (2, 2), (3, 3), (5, 6), (7, 7)}
