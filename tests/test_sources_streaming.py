"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.operators import dedup, records, sections, workflow
from docspark.plans import config
from docspark.sources import landing
from docspark.streaming import events as S


@pytest.fixture
def folder(tmp_path):
    for name, data in (("ingest/a/one.txt", b"same"), ("ingest/b/two.txt", b"same"), ("other/three.txt", b"x" * 500)):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True)
        path.write_bytes(data)
    return tmp_path / "in"


def test_scan_landing(spark, folder):
    rows = {r.file_name: r for r in landing.scan_landing(spark, str(folder), 100).collect()}
    assert rows["one.txt"].document_id == "a" and rows["two.txt"].document_id == "b"
    assert rows["one.txt"].content_hash == rows["two.txt"].content_hash
    assert rows["three.txt"].status == "SKIPPED" and len(rows["three.txt"].document_id) == 32


def test_reference_text(spark, tmp_path):
    (tmp_path / "p.doc.txt").write_text("policy")
    (tmp_path / "q.xyz").write_text("no")
    rows = landing.scan_reference_text(spark, str(tmp_path)).collect()
    assert [(r.text, r.file_type) for r in rows] == [("policy", "docx")]


def test_audit_round_trip(spark, tmp_path):
    landing.write_audit(spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int"), str(tmp_path / "audit"))
    assert {(r.document_id, r.n) for r in spark.read.json(str(tmp_path / "audit")).collect()} == {("a", 1), ("b", 2)}


def test_model_json(spark):
    replies = ['```json\n[{"a": 1},]\n```', 'Sure: [{"a": 2}] ok', '[{"a": 3}, {"a": 4}, {"a"', "none", None, '[{"a": None}]']
    rows = landing.parse_model_json(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string"), "r", "array<struct<a:int>>").orderBy("i").collect()
    assert [None if r.parsed is None else [x.a for x in r.parsed] for r in rows] == [[1], [2], [3, 4], None, None, [None]]


def test_stream_ingest_and_dedup_equal_batch(spark, folder, tmp_path):
    files = S.stream_ingest(spark, str(folder))
    q = S.stream_dedup(files).select("content_hash").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fresh").count() == 2
    batch = landing.scan_landing(spark, str(folder)).select(F.xxhash64("original_key").alias("doc_id"), "content_hash")
    known = batch.where("false").select("content_hash", F.col("doc_id").alias("document_id"))
    assert dedup.dedup_against_history(batch, known).where("status = 'STARTED'").count() == 2


def test_stream_state_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("event_type").alias("message"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = S.stream_document_state(stream).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = {tuple(r) for r in S.stream_document_state(rows).collect()}
    assert {tuple(r) for r in spark.table("state").collect()} == want
    late = S.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    late.awaitTermination(240)
    assert spark.table("late").count() > 0


def test_stream_with_config(spark, tmp_path):
    spark.createDataFrame([("s1", 2)], "section_id string, factor int").write.parquet(str(tmp_path / "cfg"))
    spark.range(5).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
    q = S.each_batch_with_config(stream, str(tmp_path / "cfg"), lambda b, c: b.join(F.broadcast(c), F.lit(True)).select((F.col("id") * F.col("factor")).alias("v")), str(tmp_path / "out"), str(tmp_path / "c4"))
    q.awaitTermination(120)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def test_stream_pipeline_equals_batch_and_survives_a_second_run(spark, tmp_path):
    from docspark.operators import pages

    texts = {"a": "the and that with of nation " * 40, "b": "que pour les " * 30, "c": "the and that with of nation " * 40, "d": "x"}
    for name, text in texts.items():
        path = tmp_path / "in" / "ingest" / name / f"{name}.txt"
        path.parent.mkdir(parents=True)
        path.write_text(text)
    run = lambda: S.stream_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), config.sections(spark), config.rules(spark), 200, 2).awaitTermination()
    run()
    read = lambda: {(r.doc_id, r.status, r.pages) for r in spark.read.parquet(str(tmp_path / "out/records")).collect()}
    first = read()
    assert {x[1] for x in first if x[0] in "ac"} == {"STARTED", "DUPLICATE"} and len(first) == 4
    started = [n for n in texts if (n, "STARTED") in {x[:2] for x in first}]
    quality = pages.page_quality(pages.paginate(spark.createDataFrame([(n, texts[n]) for n in started], "doc_id string, text string"), 200))
    scored = sections.page_scores(quality, config.sections(spark), config.rules(spark))
    want = sections.extraction_plan(sections.select_pages(scored, config.sections(spark)), scored, config.sections(spark))
    plans = spark.read.parquet(str(tmp_path / "out/plans"))
    assert sorted(map(str, plans.select(want.columns).collect())) == sorted(map(str, want.collect()))
    more = tmp_path / "in" / "ingest" / "e" / "e.txt"
    more.parent.mkdir()
    more.write_text(texts["b"])
    run()
    assert read() - first == {("e", "DUPLICATE", None)}


def test_key_values_and_edges(spark):
    blocks = spark.createDataFrame(
        [(1, "k", "KEY_VALUE_SET", None, 90.0, ["KEY"], [("VALUE", ["v"]), ("CHILD", ["w1", "w2"])]), (1, "v", "KEY_VALUE_SET", None, 80.0, ["VALUE"], [("CHILD", ["w3"])]), (1, "w1", "WORD", "Loan", 99.0, [], []), (1, "w2", "WORD", "Amount", 99.0, [], []), (1, "w3", "WORD", "$5", 99.0, [], [])],
        "doc_id int, id string, block_type string, text string, confidence double, entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>",
    )
    rows = records.key_values(blocks, records.block_edges(blocks)).collect()
    assert [(r.key, r.value, r.confidence) for r in rows] == [("Loan Amount", "$5", 80.0)]


def test_mask_paths_for_viewers(spark):
    df = spark.createDataFrame([(1, ("123-45-6789",))], "id int, d struct<ssn:string>")
    assert records.mask_paths(df, {"d.ssn": "ssn"}, can_view=True).first().d.ssn == "123-45-6789"
    assert records.mask_paths(df, {"d.ssn": "ssn"}, can_view=False).first().d.ssn == "***-**-6789"


def test_scores_round_half_to_even(spark):
    from docspark.operators import compliance

    rows = [(1, "b", v) for v in ["PASS"] + ["FAIL"] * 7] + [(2, "b", "NOT_APPLICABLE")]
    got = {r.doc_id: r.overall_score for r in compliance.report_scores(spark.createDataFrame(rows, "doc_id int, baseline_id string, verdict string")).collect()}
    assert got == {1: 12, 2: 0}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    scores = spark.createDataFrame([(1, "b", 12)], "doc_id int, baseline_id string, overall_score int")
    assert {r.doc_id: r.overall_score for r in compliance.scores_with_missing(docs, scores).collect()} == {1: 12, 2: -1, 3: -1}


def test_review_chain(spark):
    docs = spark.createDataFrame([(1, "PENDING_REVIEW", 1)], "document_id int, review_status string, version int")
    acts = spark.createDataFrame([(1, "approve", 1, None, 5, 1), (1, "correct", 1, None, 9, 2), (1, "reject", 2, None, 6, 3), (1, "reject", 2, "why", 7, 4), (1, "approve", 4, None, 8, 5)], "document_id int, action string, expected_version int, notes string, ts int, action_id int")
    row = workflow.apply_review_actions(docs, acts).first()
    assert (row.review_status, row.version) == ("REJECTED", 3)


def test_entry_without_llm_imports(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "extraction_plan" in names and json.dumps(sorted(names))
    assert __spark_entry__.oracle_sql().keys() <= names
    assert sections.primary_section(config.sections(spark)).first().section_id == "s_junk"
