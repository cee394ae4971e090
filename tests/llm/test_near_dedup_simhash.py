"""The pipeline's near_dedup goes through SimHash: fingerprints bit by bit, blocks, distances, and no path beside them."""

import random

import numpy as np

from docspark.llm import simhash


def distance(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_wide_fingerprints_bit_by_bit():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(n % 2)) for n in (1, 2, 5, 254, 255, 256, 600)]
    got = simhash.wide_fingerprints(sets, 5)
    for s, row in zip(sets, got, strict=True):
        alone = simhash.wide_fingerprints([s], 3)[0]
        assert (alone == row[:3]).all()
        assert int(row[0]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
        assert len(set(row.tolist())) == 5
    assert simhash.wide_fingerprints([], 4).shape == (0, 4)


def test_pairs_of_just_the_similarity_share_a_block_within_the_distance():
    rng = np.random.default_rng(3)
    for n in (1000, 3_000_000):
        blocks = simhash._blocks(n, 0.8)
        for shared, x, y in ((4, 0, 1), (12, 1, 2), (36, 4, 5), (100, 0, 25), (400, 50, 50)):
            few = shared + y <= simhash.FEW
            sets = []
            for _ in range(400):
                h = rng.permutation(np.unique(rng.integers(1, 1 << 63, shared + x + y + 9, dtype=np.uint64) * np.uint64(2)))[: shared + x + y]
                h ^= rng.integers(0, 2, len(h), dtype=np.uint64)
                sets += [h[: shared + x], np.concatenate([h[:shared], h[shared + x :]])]
            fp = simhash.wide_fingerprints(sets, blocks.words(few))
            bits = np.unpackbits(fp.view(np.uint8), axis=1)[:, : blocks.count[few] * blocks.width].reshape(len(sets), blocks.count[few], -1)
            for k in range(0, len(sets), 2):
                assert (bits[k] == bits[k + 1]).all(axis=1).any()
                assert distance(fp[k, : simhash.DISTANCE_WORDS], fp[k + 1, : simhash.DISTANCE_WORDS]) <= blocks.bits[few]
                assert distance(fp[k, :1], fp[k + 1, :1]) <= blocks.first[few]


def test_groups_of_a_bucket_hold_all_near_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)
    rng = np.random.default_rng(6)
    blocks = simhash._blocks(1000, 0.8)
    fp = rng.integers(0, 1 << 63, (420, 3), dtype=np.uint64)
    for k in range(100, 400):  # a large group, and chains of near ones
        fp[k] = fp[100 if k < 300 else k - 1]
        for b in rng.integers(0, 192, rng.integers(0, 60 if k < 300 else 40)):
            fp[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    size = np.sort(rng.integers(60, 200, 420))
    fp = fp[rng.permutation(420)]
    root = simhash._near_roots(fp, size, blocks, 0.8)
    pairs = [(i, j) for i in range(420) for j in range(i) if distance(fp[i], fp[j]) <= blocks.bits[0] and distance(fp[i, :1], fp[j, :1]) <= blocks.first[0] and size[j] >= 0.8 * size[i]]
    assert len(pairs) > 1000 and all(root[i] == root[j] for i, j in pairs)
    assert len(set(root.tolist())) > 100


def test_no_path_beside_the_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (7, 30, 400)]
    texts = [" ".join(t) for b in base for t in (b, [*b, "more"], ["more", *b])] + ["", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r.component for r in simhash.jaccard_components(df, "doc_id", "text").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 6, 9: 9, 10: 9, 11: 11}

    def nothing(batches):
        for b in batches:
            yield b.select(["at", "node"]).rename_columns(["u", "v"]).slice(0, 0)

    monkeypatch.setattr(simhash, "_near_groups", lambda *_: nothing)
    got = {r.id: r.component for r in simhash.jaccard_components(df, "doc_id", "text").collect()}
    assert got == {i: 9 if i == 10 else i for i in range(12)}


def test_smallest_of_a_region_is_compared(spark):
    """Groups around node 3, which is like neither 1 nor 2; 1 and 2 are alike."""
    sets = {1: range(50), 2: range(2, 52), 3: range(20, 80)}
    sets = spark.createDataFrame([(k, bytearray(np.array(x, np.uint64).tobytes())) for k, x in sets.items()], "node long, sh binary")
    placed = spark.createDataFrame([(3, k, k) for k in (1, 2, 3)], "key long, node long, root long")
    assert [sorted((r.u, r.v)) for r in simhash._rest_links(placed, sets, 0.8).collect()] == [[1, 2]]


def test_components_take_few_and_short_rounds(spark, monkeypatch):
    """The driver plans each round: none for edges that point to their roots already, and few exchanges in each."""
    plans = []

    def noted(df):
        df = df.cache()
        df.count()
        plans.append(df._jdf.queryExecution().analyzed().toString().count("LogicalRDD"))
        return df.localCheckpoint()

    monkeypatch.setattr(simhash, "materialize", noted)
    rng = random.Random(4)
    star = [(0, k) for k in range(1, 40)] + [(100, 101), (7, 7)]
    path = [(k, k + 1) for k in range(200, 260)]
    some = [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(90)]
    for pairs, rounds in ((star, 0), (star + path + some, 8), ([], 0)):
        plans.clear()
        got = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        root = {x: x for p in pairs for x in p if p[0] != p[1]}
        while any(root[u] != root[v] for u, v in pairs if u != v):
            for u, v in pairs:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        assert got == {x: r for x, r in root.items() if x != r}
        assert len(plans) <= 1 + rounds
        assert all(n <= 5 for n in plans[1:])
