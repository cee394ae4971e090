"""Streams that run again, contents pages, rules, merging and JSON as models write it."""

import datetime
import json

from pyspark.sql import functions as F

from docspark.operators import compliance, profiles, records, trees, workflow
from docspark.sources import blocks, landing
from docspark.streaming import events as S


def test_a_batch_run_twice_leaves_one_copy(spark, tmp_path):
    spark.createDataFrame([(2,)], "factor int").write.parquet(str(tmp_path / "cfg"))
    spark.range(5).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
    apply = lambda b, c: b.join(F.broadcast(c), F.lit(True)).select((F.col("id") * F.col("factor")).alias("v"))
    for checkpoint in ("a", "b"):  # a lost checkpoint makes the same batch run again
        S.each_batch_with_config(stream, str(tmp_path / "cfg"), apply, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(60)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def test_configuration_is_read_again_by_age(spark, tmp_path):
    at, now = str(tmp_path / "cfg"), [0.0]
    write = lambda n: spark.createDataFrame([(n,)], "n int").write.mode("overwrite").parquet(at)
    table = S.Refreshed(at, 60, lambda: now[0])
    write(1)
    assert table.get(spark).first().n == 1
    write(2)
    now[0] = 59.0
    assert table.get(spark).first().n == 1
    now[0] = 61.0
    assert table.get(spark).first().n == 2


def test_section_progress_over_a_restart(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    acts = ["start", "finish", "start", "fail", "skip", "start"]
    rows = [(k % 7, f"s{k * 5 % 4}", acts[k * 11 % 6], t + datetime.timedelta(minutes=k * 37 % 300), k) for k in range(200)]
    schema = "document_id long, section_id string, action string, ts timestamp, event_id long"
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in (rows[:90], rows[90:]):  # the second run goes on from the checkpoint of the first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        S.run_progress(spark.readStream.schema(schema).parquet(src), out, cp)
    got = S.latest_progress(spark.read.schema(f"{S.PROGRESS}, batch int").parquet(out))
    want = workflow.section_progress(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_contents_pages_do_not_count(spark):
    entries = spark.createDataFrame([(1, 0, "Definitions", 2), (2, 0, "Loans", 3)], "doc_id int, seq int, title string, printed_page int")
    contents = "CONTENTS\nDefinitions ..... 2\nLoans ..... 9"
    pages = spark.createDataFrame([(1, 1, contents), (1, 5, "Article 1. Definitions. Terms mean"), (2, 2, "Loans  3\nFees  4\nNotices  12"), (2, 6, "2. Loans\nThe loans are"), (2, 9, "loans")], "doc_id int, page_number int, text string")
    assert {r.doc_id: (r.page_shift, r.confident) for r in trees.page_offset(entries, pages).collect()} == {1: (3, True), 2: (3, True)}
    texts = {contents: True, "a . . . . 3\nb . . . . . 7": True, "Rates\nterm 9\nbase 4\nfee 7": False, "One line 2024": False, "": False, "Table of Contents\nno numbers": False}
    flags = spark.createDataFrame(list(texts), "string").select("value", trees.is_contents(F.col("value")).alias("c"))
    assert {r.value: r.c for r in flags.collect()} == texts


LOAN = dict(doc_id=1, amount=1200.0, rate=0.1, payment=10.0, effective_date=datetime.date(2020, 1, 1), maturity_date=datetime.date(2030, 1, 1), is_fixed=False, rate_type="x", rate_index="SOFR", borrower="b", lender="l", aggregate=100.0)
SCHEMA = "doc_id int, amount double, rate double, payment double, effective_date date, maturity_date date, is_fixed boolean, rate_type string, rate_index string, borrower string, lender string, aggregate double"


def test_each_rule_passes_and_breaks(spark):
    breaks = {
        "payment": {"payment": 30.0}, "term": {"maturity_date": datetime.date(2020, 6, 1)}, "fixed_type": {"is_fixed": True}, "variable_index": {"rate_index": " "}, "parties": {"lender": None}, "commitments": {"aggregate": 150.0},
    }
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    loans = [{**LOAN, **change, "doc_id": k} for k, change in enumerate([{}, *breaks.values(), {}, {}, {"maturity_date": None, "amount": None, "is_fixed": None}])]
    n = len(loans)
    lenders = [(k, s, c) for k in range(n) for s, c in ((0.6, 60.0), (0.4 if k != 7 else 0.7, 40.0))]
    tiers = [(k, level, spread) for k in range(n) for level, spread in ((1, 1.0), (2, None), (3, 1.5 if k != 8 else 0.5))]
    got = records.sanity_rules(spark.createDataFrame([tuple(x[c] for c in names) for x in loans], SCHEMA), spark.createDataFrame(lenders, "doc_id int, share double, commitment double"), spark.createDataFrame(tiers, "doc_id int, level_no int, spread double"))
    assert {r.doc_id: r.failed for r in got.collect()} == {0: "", **{k: name for k, name in enumerate(breaks, 1)}, 7: "shares", 8: "spreads", 9: ""}
    alone = records.sanity_rules(spark.createDataFrame([tuple(LOAN[c] for c in names)], SCHEMA))
    assert alone.first().failed == ""


def test_partial_records_with_overlapping_events(spark):
    rows = spark.createDataFrame([(1, 1, "PROCESSING", None, [(3, "c"), (1, "a")]), (1, 2, "LOAN", "x", [(2, "b"), (4, "d")]), (1, 3, "OTHER", "y", None), (2, 1, "LOAN", None, [])], "doc_id int, seq int, document_type string, name string, events array<struct<ts:int,what:string>>")
    got = {r.doc_id: r for r in records.merge_partial_records(rows, ["name"], "LOAN").collect()}
    assert (got[1].name, [x.what for x in got[1].events or []], got[1].dropped, got[1].parts) == ("x", ["a", "b", "c", "d"], ["OTHER", "PROCESSING"], 3)
    assert (got[2].name, got[2].events, got[2].dropped) == (None, [], [])


def test_strings_in_json_are_never_changed(spark):
    texts = {'{"a": "x, None, y"}': {"a": "x, None, y"}, '{"a": "list [1, ]"}': {"a": "list [1, ]"}, '```json\n{"a": "None", "b": None,}\n```': {"a": "None", "b": None}, 'so: {"a": "q\\" True ,}", "b": [True, 1,],} end': {"a": 'q" True ,}', "b": [True, 1]}, '{"a": "```"}': {"a": "```"}, "none": None, "": None, "[1, 2": None}
    assert {t: (None if landing._first_value(t) is None else json.loads(landing._first_value(t))) for t in texts} == texts
    assert json.loads(landing._first_value('[{"a": 1}, {"a": None}, {"a": ')) == [{"a": 1}, {"a": None}]
    df = spark.createDataFrame([('{"a": "x, None, y"}',), (None,)], "r string")
    assert [r.parsed and r.parsed.a for r in landing.parse_model_json(df, "r", "a string").collect()] == ["x, None, y", None]


def test_exported_blocks_by_path_with_pruning(spark, tmp_path):
    word = lambda i, t: {"Id": i, "BlockType": "WORD", "Text": t, "Confidence": 99.0}
    key = {"Id": "k", "BlockType": "KEY_VALUE_SET", "Confidence": 90.0, "Page": 2, "EntityTypes": ["KEY"], "Relationships": [{"Type": "VALUE", "Ids": ["v"]}, {"Type": "CHILD", "Ids": ["w"]}]}
    value = {"Id": "v", "BlockType": "KEY_VALUE_SET", "Confidence": 80.0, "EntityTypes": ["VALUE"], "Relationships": [{"Type": "CHILD", "Ids": ["x"]}], "Geometry": {"Top": 1}}
    docs = {"a": [key, value, word("w", "Name"), word("x", "Ann")], "b": [{"Id": "s", "BlockType": "SIGNATURE", "Confidence": 91.5}]}
    for day, (name, found) in enumerate(docs.items()):
        path = tmp_path / f"day={day}" / f"{name}.json"
        path.parent.mkdir()
        path.write_text(json.dumps({"DocumentId": name, "Blocks": found, "JobStatus": "SUCCEEDED"}) + "\nno json\n" + json.dumps({"DocumentId": "none"}))
    rows = blocks.scan_blocks(spark, str(tmp_path), "day int")
    assert {(r.doc_id, r.page, r.id, r.day) for r in rows.collect()} == {("a", 2, "k", 0), ("a", 1, "v", 0), ("a", 1, "w", 0), ("a", 1, "x", 0), ("b", 1, "s", 1)}
    pairs = records.key_values(rows, records.block_edges(rows)).collect()
    assert [(r.doc_id, r.key, r.value, r.confidence) for r in pairs] == [("a", "Name", "Ann", 80.0)]
    assert [(r.doc_id, r.id, r.meets_threshold) for r in records.signatures(rows).collect()] == [("b", "s", True)]
    plan = rows.where("day = 1").select("doc_id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "Geometry" not in plan


def test_requirements_with_their_places(spark):
    text = "..Start. It must be so!\nThey shall\nnot. And at least one page border crosses here, it is required to. End"
    cuts = [0, 12, 12, 40, len(text)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    pages = spark.createDataFrame([(1, k + 1, text[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "doc_id int, page_number int, text string")
    nodes = spark.createDataFrame([(1, 1, "one", 3), (1, 2, "two", 4), (1, 3, "two b", 4)], "doc_id int, seq int, title string, start_index int")
    got = compliance.extract_requirements(docs, pages=pages, nodes=nodes).orderBy("seq").collect()
    page = lambda at: max(k + 1 for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a <= at and a < b)
    for r in got:
        at = text.index(r.text)
        end = at + len(r.text) - 1
        assert (r.first_page, r.last_page) == (page(at - 1), page(end))
        assert r.source_section == {1: None, 3: "one", 4: "two b"}[r.first_page]
    assert [r.text for r in got] == ["It must be so", "They shall", "And at least one page border crosses here, it is required to"]
    assert [r.seq for r in compliance.extract_requirements(docs).orderBy("seq").collect()] == [r.seq for r in got] == [2, 3, 5]


def test_legacy_defaults(spark):
    pages = spark.createDataFrame([(d, p, n) for d, n in ((1, 8), (2, 2)) for p in range(1, n + 1)], "doc_id int, page_number int, total_pages int")
    chosen = spark.createDataFrame([(1, "signatures", 4), (1, "agreementInfo", 8), (2, "parties", 2)], "doc_id int, section_id string, page_number int")
    got = sorted(tuple(r) for r in profiles.legacy_defaults(chosen, pages).collect())
    assert got == sorted([(1, "agreementInfo", p) for p in range(1, 6)] + [(1, "signatures", 4), (2, "agreementInfo", 1), (2, "agreementInfo", 2), (2, "parties", 2), (2, "signatures", 1), (2, "signatures", 2)])
