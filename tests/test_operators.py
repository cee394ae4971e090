"""Operators on small rows: golden values, edge cases and invariants."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import compliance, dedup, extraction, pages, profiles, records, sections, shared, trees
from docspark.plans import config


def test_encrypting_twice_changes_nothing(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    rows = [(1, "a", "x"), (2, None, "y"), (3, "[ENCRYPTED]", None), (4, "", "z")]
    df = spark.createDataFrame(rows, "id int, name string, note string")
    once = records.encrypt_columns(df, ["name"], key).checkpoint()
    twice = records.encrypt_columns(once, ["name"], key).checkpoint()
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    both = records.encrypt_columns(twice, ["note", "name"], key)
    assert sorted(map(tuple, records.decrypt_columns(both, ["name", "note"], key).collect()), key=str) == sorted(rows, key=str)
    late = once.withColumn("name", F.when(F.col("id") == 1, "new").otherwise(F.col("name")))
    assert {r.id: r.name for r in records.decrypt_columns(records.encrypt_columns(late, ["name"], key), ["name"], key).collect()}[1] == "new"


def nearest_shallower(depths):
    stack, out = [], []
    for k, d in enumerate(depths, 1):
        while stack and stack[-1][0] >= d:
            stack.pop()
        out.append(stack[-1][1] if stack else None)
        stack.append((d, k))
    return out


def test_trees_of_any_depth(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(30):
        depths = [rng.randint(0, 14 if doc % 3 else 2) for _ in range(rng.randint(1, 25))]
        rows += [(doc, k, ".".join(["1"] * (d + 1)), f"t{k}", k + 1) for k, d in enumerate(depths)]
        want[doc] = (depths, nearest_shallower(depths))
    entries = spark.createDataFrame(rows, "doc_id int, entry_id int, structure string, title string, physical_page int")
    nodes = trees.tree_parents(entries)
    totals = entries.groupBy("doc_id").agg((F.max("physical_page") + 2).alias("total_pages"))
    got = {}
    for r in trees.tree_end_pages(nodes, totals).collect():
        got.setdefault(r.doc_id, {})[r.seq] = r
    for doc, (depths, parents) in want.items():
        assert [got[doc][k].parent for k in range(1, len(depths) + 1)] == parents
        for k, d in enumerate(depths):
            after = [j for j in range(k + 1, len(depths)) if depths[j] <= d]
            end = after[0] + 1 - 1 if after else len(depths) + 2
            assert got[doc][k + 1].end_index == max(k + 1, end)


def test_split_oversized_leaves_others_alone(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0, "a", 1, 9), (1, 2, None, 0, "b", 10, 30)], "doc_id int, seq int, parent int, depth int, title string, start_index int, end_index int")
    headings = spark.createDataFrame([(1, 0, "1", "in a", 2), (1, 1, "1", "first", 12), (1, 2, "1.1", "deeper", 15), (1, 3, "2", "second", 20), (2, 4, "1", "other", 12)], "doc_id int, entry_id int, structure string, title string, page_number int")
    over = spark.createDataFrame([(1, 2)], "doc_id int, seq int")
    got = [(r.leaf, r.seq, r.parent, r.title, r.start_index, r.end_index) for r in trees.split_oversized(nodes, over, headings).orderBy("seq").collect()]
    assert got == [(2, 1, None, "first", 12, 19), (2, 2, 1, "deeper", 15, 19), (2, 3, None, "second", 20, 30)]


def test_verdicts_cover_every_requirement(spark):
    chosen = spark.createDataFrame([(1, "b"), (2, "b"), (3, "none")], "doc_id int, baseline_id string")
    reqs = spark.createDataFrame([("b", "r1", ["insurance", "policy"]), ("b", "r2", ["audit"]), ("b", "r3", [])], "baseline_id string, requirement_id string, terms array<string>")
    texts = spark.createDataFrame([(1, 1, "The INSURANCE."), (1, 2, "A policy, insurance."), (2, 1, "audit?")], "doc_id int, page_number int, text string")
    got = {(r.doc_id, r.requirement_id): (r.verdict, r.confidence, r.first_page, r.page_references) for r in compliance.evaluate_requirements(chosen, reqs, texts).collect()}
    assert got == {
        (1, "r1"): ("PASS", 1.0, 1, [1, 2]), (1, "r2"): ("NOT_FOUND", 0.0, None, None), (1, "r3"): ("NOT_FOUND", 0.0, None, None),
        (2, "r1"): ("NOT_FOUND", 0.0, None, None), (2, "r2"): ("PASS", 1.0, 1, [1]), (2, "r3"): ("NOT_FOUND", 0.0, None, None),
    }

    def strict(rows):
        return rows.withColumns({"verdict": F.when(F.coalesce("found", F.lit(0)) == F.col("n_terms"), "PASS").otherwise("FAIL"), "confidence": F.lit(0.5)})

    own = {(r.doc_id, r.requirement_id): r.verdict for r in compliance.evaluate_requirements(chosen, reqs, texts, strict).collect()}
    assert own[1, "r1"] == "PASS" and own[2, "r1"] == "FAIL" and len(own) == 6


def test_leaves_of_nested_json(spark):
    deep = {"a": {"b": {"c": {"d": {"e": 1, "f": {"g": 2}}}}}, "l": [1, [2, {"m": "x"}]], "_h": {"k": 1}, "n": None, "s": "", "o": {}, "t": True}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None), (4, "7"), (5, "{}")], "doc_id int, j string")
    got = {(r.doc_id, r.path): r.value for r in records.leaf_paths(df, "j", 5).collect()}
    assert {(r.doc_id, r.path): r.value for r in records.leaf_paths(df, "j").collect()} == got | {(1, "a.b.c.d.f.g"): "2"}
    assert got == {(1, "a.b.c.d.e"): "1", (1, "l[0]"): "1", (1, "l[1][0]"): "2", (1, "l[1][1].m"): "x", (1, "t"): "true"}
    assert {r.doc_id: r.fields for r in records.count_fields(df, "j").collect()} == {1: 7, 2: 0, 3: 0, 4: 0, 5: 0}
    wrapped = spark.createDataFrame([(1, json.dumps({"x": {"y": [1, {"z": "q"}]}, "audit": {"u": 1}})), (2, json.dumps({"loanData": {"k": [1]}}))], "doc_id int, payload string")
    assert {r.doc_id: json.loads(r.data) for r in extraction.unwrap_payload(wrapped).collect()} == {1: {"x": {"y": [1, {"z": "q"}]}}, 2: {"k": [1]}}


def test_pages_join_to_their_text(spark):
    texts = ["", None, "x", "é😀\n" * 700, "a" * 1500, "b" * 1501]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pages.paginate(df).collect()
    for k, t in enumerate(texts):
        own = sorted((r.page_number, r.text, r.total_pages) for r in rows if r.doc_id == k)
        assert "".join(x[1] for x in own) == (t or "")
        assert [x[0] for x in own] == list(range(1, own[0][2] + 1)) and all(len(x[1]) <= 1500 for x in own)


def test_quality_measures_are_computed_once(spark):
    df = spark.createDataFrame([(1, 1, 1, "x")], "doc_id int, page_number int, total_pages int, text string")
    plan = pages.page_quality(df).where("is_readable")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2


def test_multipart_etag(spark):
    data = bytes(range(256)) * 11
    parts = [data[k : k + 1000] for k in range(0, len(data), 1000)]
    want = hashlib.md5(b"".join(hashlib.md5(p).digest() for p in parts)).hexdigest() + f"-{len(parts)}"
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"ab"),)], "b binary")
    assert [r.e for r in df.select(T.multipart_etag(F.col("b"), 1000).alias("e")).collect()] == [want, hashlib.md5(b"ab").hexdigest()]


def test_legacy_profiles(spark):
    text = "Schedule 2.01 of the commitments: each bank pays $5 which is 100.00% of all that"
    page = spark.createDataFrame([(1, 2, 3, text, True, True)], "doc_id int, page_number int, total_pages int, text string, is_readable boolean, has_text boolean")
    got = {r.section_id: r.bonus for r in sections.rule_bonus(page, profiles.legacy_rules(spark)).collect()}
    assert got == {"agreementInfo": 1, "lenderCommitments": 18, "signatures": 10, "loanTerms": 3, "parties": 3}


def test_statements_of_any_length(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    texts = [long, long + " more", "short one", "Short, one!", "", "", "unlike"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = {r.doc_id for r in dedup.dedup_statements(df).collect() if r.kept}
    assert kept == {1, 3, 4, 6}


def test_records_and_signatures(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    defs = spark.createDataFrame([("a", "number", True, None, 0.0, 5.0), ("b", "string", True, None, None, None)], "field_id string, field_type string, required boolean, validation_regex string, min_value double, max_value double")
    values = spark.createDataFrame([(1, "a", "3"), (1, "b", "x"), (2, "a", "9")], "doc_id int, field_id string, value string")
    got = {r.doc_id: (r.is_valid, r.n_fields, r.n_errors, r.invalid) for r in records.validate_record(docs, defs, values).collect()}
    assert got == {1: (True, 2, 0, []), 2: (False, 2, 2, ["a", "b"])}
    kv = spark.createDataFrame([(1, "k", "late", 80.0, 2), (1, "k", "early", 80.0, 1), (1, "k", "poor", None, 0)], "doc_id int, key string, value string, confidence double, page_number int")
    assert [(r.value, r.page_number) for r in records.best_value_per_key(kv).collect()] == [("early", 1)]


def test_selection_needs_no_text(spark):
    rows = [(d, "the and that with of " * 20 if d % 2 else "§§ %% /1 /2") for d in range(6)]
    quality = pages.page_quality(pages.paginate(spark.createDataFrame(rows, "doc_id int, text string"), 100))
    scored = sections.page_scores(quality, config.sections(spark), config.rules(spark))
    assert "text" not in scored.columns
    plan = sections.extraction_plan(sections.select_pages(scored, config.sections(spark)), scored, config.sections(spark))
    assert {r.doc_id for r in plan.select("doc_id").distinct().collect()} == set(range(6))


def test_configuration_of_any_size_gives_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"page {k} on loans and fees") for k in range(40)] + [(None, None)], "doc_id int, text string").repartition(3)
    codes = spark.createDataFrame([(1, "LOANS", "L"), (2, "page 1", "P"), (3, None, "N"), (4, "", "E")], "ordinal int, phrase string, code string")
    want = {(k, "L") for k in range(40)} | {(None, None)}
    assert {tuple(r) for r in records.code_lookup(rows, codes).collect()} == want
    assert "BroadcastNestedLoopJoin" in shared.beside(rows, codes)._jdf.queryExecution().toString()
    assert shared.beside(rows, codes.where("false")).count() == 0
    monkeypatch.setattr(shared.broadcast_if_small, "__defaults__", (0,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "CartesianProduct" in shared.beside(rows, codes)._jdf.queryExecution().toString()
        assert {tuple(r) for r in records.code_lookup(rows, codes).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
