"""The pipeline against its stages done by hand, row by row; rules of the classifier likewise; odd tables."""

import heapq
import math
import random

from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import decontaminate, pii, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, gone string, score double"


def by_rules(model, text):
    stats = dict(zip(quality.STATS, quality.statistics((text or "").encode()), strict=True))
    total = model.bias
    for rule, weight in zip(model.rules, model.weights, strict=True):
        if all((stats[quality.STATS[f]] <= x) if below else (stats[quality.STATS[f]] > x) for f, below, x in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_scores_equal_rules_row_by_row(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(quality.labelled_rows(quality.with_stats(docs), labels))
    assert model.rules
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id].score - by_rules(model, r.text)) < 1e-9
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if i in got and got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slots(sizes, period=1000):
    """Slots of each source: square-root weights, largest remainders, earliest deadline first."""
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    q = max(period, 8 * len(names))
    w = [math.sqrt(sizes[s]) for s in names]
    share = [(q - len(names)) * x / sum(w) for x in w]
    low = [math.floor(x) for x in share]
    order = sorted(range(len(names)), key=lambda i: (-round(share[i] - low[i], 9), i))
    for i in order[: q - len(names) - sum(low)]:
        low[i] += 1
    c = [1 + x for x in low]
    future = sorted((k * q // x, -(-(k + 1) * q // x), i) for i, x in enumerate(c) for k in range(x))
    out, ready, at = {s: [] for s in names}, [], 0
    for t in range(q):
        while at < len(future) and future[at][0] <= t:
            heapq.heappush(ready, future[at][1:])
            at += 1
        out[names[heapq.heappop(ready)[1]]].append(t)
    return out, q


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_equals_stages_by_hand(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, words(20)) for k in range(4)] + [(9, None), (10, "")]
    texts = [words(rng.randint(30, 200)).capitalize() + "." for _ in range(150)]
    texts += [" ".join(w + rng.choice(["***", "###", "&&&"]) for w in words(rng.randint(20, 120)).split()) for _ in range(80)]
    for k in range(30):  # copies, near copies, leaks, personal data
        base = texts[k]
        texts += [base, base + " More.", base + " " + items[k % 4][1].upper() if k % 3 == 0 else base + f" mail {k}x@mail.org, 4111111111111111 and 2024-01-{k % 28 + 1:02d}"]
    texts += ["", None, "a", words(60_000)]
    docs = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "x", 1.0) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    labels = [(i, int(i < 150), 0) for i in range(230)] + [(None, 1, 0), (1, None, 0)]
    tables(spark, tmp_path, docs, labels, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(quality.labelled_rows(quality.with_stats(frame), spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = {i: t for i, t, *_ in docs if by_rules(model, t) >= 0.5}
    assert 100 < len(kept) < len(docs) - 60
    grams = {i: shingles(t) for i, t in kept.items()}
    ids, root = sorted(kept), {i: i for i in kept}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if grams[i] == grams[j] or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    memo, leaks = {}, [(k, decontaminate.token_hashes(t, {})) for k, t in items if t]
    kept = {i: t for i, t in kept.items() if not any(max(decontaminate.coverage(b, d, x) for x in range(-len(b), len(d))) >= 0.8 for d in [decontaminate.token_hashes(t, memo)] if 0 < len(d) < 1000 for _, b in leaks)}
    kept = {i: None if t is None else pii.pseudonymize(t, pii.DEFAULT_KEY.encode()) for i, t in kept.items()}
    assert got.keys() == kept.keys()
    assert all(got[i].text == t for i, t in kept.items())
    source = {i: s for i, _, _, s, *_ in docs}
    sizes = {}
    for i in kept:
        sizes[source[i]] = sizes.get(source[i], 0) + 1
    at, q = slots(sizes)
    for s in sizes:
        for rank, i in enumerate(sorted(k for k in kept if source[k] == s)):
            block = rank // 16
            assert (got[i].mix_block, got[i].mix_slot) == (block, block // len(at[s]) * q + at[s][block % len(at[s])])


def test_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, empty texts; then tables without rows. Every stage keeps the columns of documents."""
    docs = [(1, "same words in here", "en", "a", 1, None, None), (1, "same words in here", "en", "a", 1, None, None), (None, "no id at all", None, None, None, "y", 2.0), (None, None, None, None, None, None, None), (2, "", "de", "", 0, "", 0.0)]
    tables(spark, tmp_path / "odd", docs, [(1, 1, 0)], [(1, "one two three four five six")])
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(r.doc_id or -1 for r in rows) == [-1, -1, 1, 2]
    tables(spark, tmp_path / "none", [], [], [])
    df = spark.read.parquet(f"{tmp_path}/none/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path / "none"))
        assert out.columns[: len(df.columns)] == df.columns and (name == "mixing" or out.columns == df.columns)
        assert out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).where(F.lit(True)).count() == 0
