"""The queries of texts against their SQL, on texts that the given tables do not hold: null, empty, blank, odd white space."""

import duckdb
import pytest

from docspark.plans import registry

TEXTS = [
    None, "", " ", "\n", "abc", "\t x", "the rate of interest, " * 40, "/12 /34 " * 60, "### @ license " * 60, "los que de la ción ñ " * 60,
    "the loan and that agreement with a section of @ " * 200, "", None, "die und schön ein ß " * 100, " " * 900,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    return con


def same(spark, duck, tables, name):
    df = registry.queries()[name](spark, tables)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(tuple("~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = plain(df.select(*columns).collect())
    assert got and got == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["page_quality", "extraction_plan", "plan_coverage", "page_selection", "route_low_quality", "cover_uncovered", "dedup_across_sections", "expand_neighbours", "reclassify_if_empty", "billable_pages", "hybrid_merge", "pick_best_parse", "rule_bonus", "keyword_matches", "section_scores", "top_pages", "legacy_bonus_profiles", "legacy_defaults"])
def test_pages_without_text(spark, duck, tables, name):
    same(spark, duck, tables, name)


def test_heading_entries_of_lines_with_numbers_and_separators(spark, tmp_path):
    texts = ["a\n4919538112535716 b\n28.6.1.2 c\n70.32.29.134 d", "\x0b x\ny\n\x0b\nz", "a\rb\nc\ne\r\nf", "p\u2028q\nr\n\u0085", " \r\n1 x\n\t", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(spark, con, str(tmp_path), "heading_entries")


def test_sets_of_shingles_stay_where_they_are(spark):
    from docspark.operators import dedup

    texts = ["", " ", "one two", "a b c d e", "a b c d e a b c d e f", "É, é: Straße 12", "x " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = df.select("doc_id", dedup.shingle_set(dedup.F.col("text")).alias("s"))
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: sorted(r.s) for r in dedup.shingles(df).groupBy("doc_id").agg(dedup.F.collect_set("g").alias("s")).collect()}
    assert {r.doc_id: list(r.s) for r in sets.collect()} == want


def test_only_prefixes_of_classes_are_shuffled(spark):
    from docspark.operators import dedup

    # A hundred shingles each, of which all share the last twenty: prefixes hold 21, and none of the common ones.
    rows = [(c, (100, -c), sorted([*range(1000 * c, 1000 * c + 80), *range(-20, 0)])) for c in range(1, 101)]
    classes = spark.createDataFrame(rows, "cls long, best struct<n:int,id:int>, s array<long>").repartition(4)
    assert dedup._common(classes).first()[0] == sorted(range(-20, 0))
    assert dedup.rare_prefixes(classes, 0.8).count() == 0
    near = spark.createDataFrame([(1, (100, -1), list(range(100))), (2, (99, -2), list(range(99)))], classes.schema)
    assert {(r.cls, r.g, r["rank"]) for r in dedup.rare_prefixes(near, 0.8).collect()} == {(c, g, g + 1) for c in (1, 2) for g in range(20)}
