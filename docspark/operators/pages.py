"""Pages of documents: cutting, quality, budgets, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import text as T


def paginate(docs: DataFrame, chars: int = 1500) -> DataFrame:
    """(doc_id, page_number, total_pages, text): one row for each slice of ``chars``; an empty text is one page.

    A text is cut in one pass, so a long one costs no more a page than a short one.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    rows = docs.select("doc_id", cut.alias("cut")).select("doc_id", F.size("cut").alias("total_pages"), F.posexplode("cut").alias("pos", "text"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("page_number"), "total_pages", "text")


def page_snippets(pages: DataFrame, n: int = 1500) -> DataFrame:
    return pages.select("doc_id", "page_number", T.strip(F.substring("text", 1, n)).alias("snippet")).withColumn("has_text", F.length("snippet") > 50)


def page_quality(pages: DataFrame) -> DataFrame:
    """``pages`` with quality_score, is_readable, issues and has_text."""
    q = pages.select("doc_id", "page_number", "total_pages", "text", T.text_quality(F.col("text")).alias("q"))
    return q.select("doc_id", "page_number", "total_pages", "text", "q.quality_score", "q.is_readable", "q.issues", "q.has_text")


def pick_best_parse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parse a of each page, unless it is unreadable and b scores strictly higher."""
    qa, qb = (x.select("doc_id", "page_number", F.col("text").alias(f"text_{n}"), T.text_quality(F.col("text")).alias(f"q_{n}")) for x, n in ((a, "a"), (b, "b")))
    both = qa.join(qb, ["doc_id", "page_number"], "left")
    other = ~F.col("q_a.is_readable") & F.coalesce(F.col("q_b.quality_score") > F.col("q_a.quality_score"), F.lit(False))
    return both.select("doc_id", "page_number", F.when(other, F.col("text_b")).otherwise(F.col("text_a")).alias("text"), F.when(other, "b").otherwise("a").alias("parser_used"))


def token_budget_groups(pages: DataFrame, max_tokens: int = 20000, overhead: int = 10) -> DataFrame:
    """Consecutive pages packed greedily: (doc_id, page_number, tokens, group_no).

    A running sum with resets is a fold; a document's (page, tokens) pairs are folded natively.
    """
    sized = pages.select("doc_id", "page_number", (T.token_estimate(F.col("text")) + overhead).alias("tokens"))
    rows = sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "tokens"))).alias("p"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("g"), F.expr("cast(array() as array<struct<page_number:int,tokens:int,group_no:int>>)").alias("out"))

    def step(a, x):
        over = (a.used > 0) & (a.used + x.tokens > max_tokens)
        g = F.when(over, a.g + 1).otherwise(a.g)
        row = F.struct(x.page_number.alias("page_number"), x.tokens.alias("tokens"), g.alias("group_no"))
        return F.struct(F.when(over, x.tokens).otherwise(a.used + x.tokens).alias("used"), g.alias("g"), F.concat(a.out, F.array(row)).alias("out"))

    return rows.select("doc_id", F.explode(F.aggregate("p", start, step, lambda a: a.out)).alias("r")).select("doc_id", "r.*")


def assemble_context(pages: DataFrame, cap: int = 50000) -> DataFrame:
    """One text a document: its distinct pages in order under page headers, cut at ``cap``."""
    block = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.col("text"))
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("page_number", block.alias("b")))).alias("p"))
    return rows.select("doc_id", T.truncated(F.array_join(F.transform("p", lambda x: x.b), "\n\n"), cap).alias("context"))


def hybrid_merge(pages: DataFrame) -> DataFrame:
    """Readable pages under one header, then the unreadable ones (from OCR) under another."""
    part = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("page_number", "text")))), lambda x: x.text), "\n")
    rows = pages.groupBy("doc_id").agg(part(F.col("is_readable")).alias("readable"), part(~F.col("is_readable")).alias("ocr"), F.count_if(F.col("is_readable")).alias("n_readable"), F.count_if(~F.col("is_readable")).alias("n_ocr"))
    method = F.when(F.col("n_ocr") == 0, "pypdf").when(F.col("n_readable") == 0, "textract_ocr").otherwise("hybrid_pypdf_ocr")
    merged = F.concat_ws("\n\n", F.when(F.col("n_readable") > 0, F.concat(F.lit("=== TEXT ===\n"), "readable")), F.when(F.col("n_ocr") > 0, F.concat(F.lit("=== OCR ===\n"), "ocr")))
    scanned = (F.length("readable") < 500) & (F.col("n_ocr") == 0)
    return rows.select("doc_id", method.alias("method"), F.length(merged).alias("merged_chars"), F.md5(merged).alias("merged_md5"), scanned.alias("is_scanned"))


def slice_first_pages(pages: DataFrame, per_page: int = 2000, per_doc: int = 10000) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.substring("text", 1, per_page).alias("t")))), lambda x: x.t), "\n")
    return pages.groupBy("doc_id").agg(F.substring(joined, 1, per_doc).alias("head"))


def billable_pages(pages: DataFrame) -> DataFrame:
    """Pages by the way they were read."""
    return pages.groupBy("doc_id").agg(F.count_if(F.col("is_readable")).alias("text_pages"), F.count_if(~F.col("is_readable")).alias("ocr_pages"), F.count("*").alias("pages"))


def latest_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
