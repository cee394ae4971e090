"""License scans against a plain loop over blocks and templates."""

import math
import random
import re

import duckdb
import pytest

from docspark.llm import licenses

RNG = random.Random(12)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, phrases, notices, containment):
    w, n = words(text), max(len(words(t)) for _, t in [*phrases, *notices])
    places = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(words(p))] == words(p)]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, t in notices:
        own = set(words(t))
        for at in range(0, len(w), n):
            share = len(own & set(w[at : at + 2 * n])) / len(own)
            if share * len(own) >= math.ceil(containment * len(own) - 1e-9):
                labels.add(label)
                score = max(score, share)
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "own", 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, label string, block int, words string").repartition(3)


def texts():
    common = "the a of and in to license under work is software permission notice copies".split()
    out = ["", None, "...", "MIT License", "mit\nlicense mit license", "MIT-LICENSE.", "mit  licensed", "gnu general public license", "CC BY-NC 4.0", "ccby", "Kapache license", "ÄPACHE LICENSE apache license", "mit license " * 300]
    for _, t in [*licenses.NOTICES, *licenses.PHRASES]:
        out += [t, t.upper(), " ".join(RNG.choices(common, k=RNG.randint(0, 400))) + " " + t + " " + " ".join(RNG.choices(common, k=RNG.randint(0, 200)))]
        for share in (0.05, 0.15, 0.3):
            out.append(" ".join(w if RNG.random() > share else "other" for w in t.split()) + " " + " ".join(RNG.choices(common, k=90)))
    return out


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)


@pytest.mark.parametrize("most", [3, licenses.MAX_WORDS])
def test_scan_equals_a_plain_loop(spark, most):
    rows = texts()
    got = {r.doc_id: row(r) for r in licenses.license_scan(frame(spark, rows), most_words=most).collect()}
    want = {k: by_hand(t, licenses.PHRASES, licenses.NOTICES, licenses.CONTAINMENT) for k, t in enumerate(rows)}
    assert got == want
    assert any(x[5] and not x[4] for x in want.values())


def test_other_templates_and_thresholds(spark):
    phrases, rng = [("aa", "a a"), ("ab", "a b a")], random.Random(5)
    for containment in (0.34, 0.5, 1.0):
        notices = [(f"n{k}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))) for k in range(6)]
        rows = [" ".join(rng.choices("abcdefghijk", [9, 9, 3, 2, 2, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 40))) for _ in range(60)]
        got = {r.doc_id: row(r) for r in licenses.license_scan(frame(spark, rows), licenses.templates(phrases, notices, containment)).collect()}
        assert got == {k: by_hand(t, phrases, notices, containment) for k, t in enumerate(rows)}


def test_repeated_and_missing_rows(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (1, "apache license"), (None, "cc by"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), *row(r)[:2], r.labels) for r in licenses.license_scan(df).collect())
    assert got == [("1", 2, 1, "apache"), ("1", 2, 1, "mit"), ("1", 2, 1, "mit"), ("None", 0, 0, ""), ("None", 2, 1, "cc-by")]
    assert licenses.license_scan(df.where("false")).count() == 0
    assert {r.labels for r in licenses.license_scan(df, []).collect()} == {""}


def test_plan_is_native_and_equals_its_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = licenses.op12(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "Arrow" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.op12_sql()})").fetchall()))
