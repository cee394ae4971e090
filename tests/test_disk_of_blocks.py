"""Blocks of documents: what the export and the joins leave on disk."""

from pathlib import Path

from docspark.plans import records, sources
from docspark.sources import blocks

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_export_of_blocks_is_compressed_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "shared_folder", lambda _: str(tmp_path))
    edges = sources.scan_blocks(spark, SF)
    files = [f for f in Path(tmp_path).rglob("*") if f.name.startswith("part-")]
    text = sum(len(r.value) for r in spark.read.text([str(f) for f in files]).collect())
    assert 5 * sum(f.stat().st_size for f in files) < text
    assert sorted(edges.collect()) == sorted(records.block_edges(spark, SF).select(*edges.columns).collect())


def test_blocks_dealt_by_document_are_not_dealt_again(spark):
    assert exchanges(records._blocks(spark, SF).groupBy("doc_id", (records.F.col("doc_id") % 8).alias("folder")).agg(records.F.count("*"))) == 1


def test_exported_lines_hold_a_document_each(spark, tmp_path):
    rows = records._blocks(spark, SF).withColumn("folder", records.F.lit(1)).where("doc_id < 50")
    blocks.write_blocks(rows, f"{tmp_path}/x", ["folder"])
    assert spark.read.json(f"{tmp_path}/x").count() == rows.select("doc_id").distinct().count()


def test_keys_and_values_shuffle_the_lines_once(spark):
    assert exchanges(records.key_values(spark, SF)) == 1


def test_keys_with_several_no_or_missing_values(spark):
    k = lambda i, *rel: (1, i, None, 90.0, ["KEY"], list(rel))
    v = lambda i, c, *words: (1, i, None, c, ["VALUE"], [("CHILD", list(words))])
    w = lambda i, t, doc=1: (doc, i, t, 99.0, [], [])
    rows = [
        k("k1", ("VALUE", ["v1"]), ("CHILD", ["b", "a"])), v("v1", 0.0, "c", "gone", "d"), k("k2", ("CHILD", ["e"])), k("k3", ("VALUE", ["none"]), ("CHILD", ["f"])),
        k("k4", ("VALUE", ["v1"])), k("k5", ("VALUE", ["v2"]), ("CHILD", ["n"])), v("v2", 50.0), k("k6", ("VALUE", ["v3"]), ("CHILD", ["f"])), v("v3", 50.0),
        w("a", "A"), w("b", "B"), w("c", "C"), w("d", "D"), w("e", "E"), w("f", "F"), w("n", None), w("gone", "other document", 2), (1, None, "nameless", 1.0, [], []),
    ]
    df = spark.createDataFrame(rows, "doc_id int, id string, text string, confidence double, entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>")
    want = {(1, "B A", "C D", 90.0), (1, "E", "", 90.0), (1, "F", "", 50.0)}
    assert {tuple(r) for r in records.R.key_values(df).collect()} == want
    assert {tuple(r) for r in records.R.key_values(df, records.R.block_edges(df)).collect()} == want
