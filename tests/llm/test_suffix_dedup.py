"""Passages of more than 50 words against brute force; buckets sorted in parts; a whole table."""

import random
import re
from collections import Counter

from docspark.llm import suffix_dedup
from tests.llm.test_corpus_operators import removed_by_hand

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passages_by_hand(texts):
    split = [WORD.findall(t) for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    out = []
    for w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                gone[i : i + 51] = b"\x01" * 51
        out.append((sum(1 for k in range(len(w)) if gone[k] and not (k and gone[k - 1])), sum(gone)))
    return out


def test_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, line = words(300), words(50)
    texts = [" ".join(base), "\n\t".join(base[40:160]), " ".join(line), " ".join(words(9) + line + words(9)), " ".join(line + ["x"]), " ".join([*line, "x", "y"]), "a " * 60, "a " * 50, "a " * 51, "", None, " \n", "b " * 51 + "c", "w" * 900]
    for _ in range(40):
        at = rng.randrange(250)
        texts.append((rng.choice([" ", "\n", "  "])).join(words(rng.randint(0, 40)) + base[at : at + rng.choice([30, 49, 50, 51, 52, 80])] + words(rng.randint(0, 40))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    want = passages_by_hand(raw)
    for block, most in ((3_000, 1 << 22), (1 << 20, 7)):
        monkeypatch.setattr(suffix_dedup, "SORTED", most)
        got = {r.doc_id: tuple(r) for r in suffix_dedup.op1(df, block).collect()}
        assert [got[k][5:] for k in range(len(texts))] == want
        assert [got[k][1:5] for k in range(len(texts))] == removed_by_hand(raw)


def test_whole_table_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    raw = [(r.text or "").encode() for r in rows]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op1(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert [got[r.doc_id] for r in rows] == [(*a, *b) for a, b in zip(removed_by_hand(raw), passages_by_hand(raw), strict=True)]
