"""Choosing pages for the sections of a document type.

The configuration is small tables: sections (ordinal, section_id, priority, keywords, min_matches,
max_pages, extract_signatures, search_last_pages) and rules (section_id, condition, patterns, bonus).
They are broadcast after a count (``beside``); scoring packs them into one row, so that each page is
read once for all sections. A selection is (doc_id, section_id,
page_number), and every step from C4 to C8 takes and gives one. Only scoring needs the pages' texts;
the other steps take the narrow table of ``page_scores``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.operators.shared import beside


def _holds(low, condition, patterns):
    """Whether a rule holds for the page; position rules also do for pages that cannot be read."""
    n = lambda default: F.coalesce(F.try_element_at(patterns, F.lit(1)).try_cast("int"), F.lit(default))
    has = lambda p: F.contains(low, F.lower(p))
    return (
        F.when(condition == "contains_any", F.exists(patterns, has))
        .when(condition == "contains_all", F.forall(patterns, has))
        .when(condition == "contains_with", has(F.try_element_at(patterns, F.lit(1))) & F.exists(F.slice(patterns, F.lit(2), F.size(patterns)), has))
        .when(condition == "first_n_pages", F.col("page_number") - 1 < n(5))
        .when(condition == "last_n_pages", F.col("page_number") - 1 >= F.col("total_pages") - n(3))
        .when(condition == "regex_match", F.exists(patterns, lambda p: F.regexp_like(low, F.concat(F.lit("(?i)"), p))))
        .otherwise(False)
    )


def _readable(pages: DataFrame) -> DataFrame:
    """``pages`` with ``low``: the text in lower case, empty where the page cannot be read."""
    return pages.withColumn("low", F.when(F.col("is_readable") & F.col("has_text"), F.lower("text")).otherwise(""))


def _matches(keywords):
    """Distinct keywords in the page; pages that cannot be read hold none."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.col("low"), F.lower(k))))


def keyword_matches(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(page columns, section columns, matches) of each page and section."""
    return beside(_readable(pages), sections).withColumn("matches", F.when(F.col("low") != "", _matches("keywords")).otherwise(0)).drop("low")


def rule_bonus(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page_number, section_id, bonus) of pages with any bonus."""
    both = beside(_readable(pages), rules).where(_holds(F.col("low"), F.col("condition"), F.col("patterns")))
    return both.groupBy("doc_id", "page_number", "section_id").agg(F.sum("bonus").cast("int").alias("bonus"))


def page_scores(pages: DataFrame, sections: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page_number, total_pages, is_readable, has_text, hits): the sections whose minimum a page reaches,
    as an array of (section_id, score, max_pages).

    A section without keywords takes its first max_pages pages. Without texts, the result is small.
    """
    own = rules.groupBy("section_id").agg(F.collect_list(F.struct("condition", "patterns", "bonus")).alias("rules"))
    row = F.struct("section_id", "keywords", F.coalesce("min_matches", F.lit(2)).alias("min_matches"), "max_pages", "rules")
    packed = sections.join(own, "section_id", "left").agg(F.collect_list(row).alias("sections"))
    both = _readable(pages).join(packed, F.lit(True), "inner")

    def score(s):
        worth = F.aggregate(F.transform(s.rules, lambda r: F.when(_holds(F.col("low"), r.condition, r.patterns), r.bonus).otherwise(0)), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(s.keywords) == 0, 0).otherwise(_matches(s.keywords) + F.coalesce(worth, F.lit(0)))

    scored = F.transform("sections", lambda s: F.struct(s.section_id.alias("section_id"), score(s).alias("score"), s.max_pages.alias("max_pages"), F.when(F.size(s.keywords) == 0, F.when(F.col("page_number") <= s.max_pages, 0).otherwise(1)).otherwise(s.min_matches).alias("least")))
    kept = F.transform(F.filter(scored, lambda x: x.score >= x.least), lambda x: F.struct(x.section_id.alias("section_id"), x.score.alias("score"), x.max_pages.alias("max_pages")))
    return both.select("doc_id", "page_number", "total_pages", "is_readable", "has_text", kept.alias("hits"))


def scores_of(scored: DataFrame) -> DataFrame:
    """(doc_id, section_id, page_number, score, max_pages) from ``page_scores``."""
    return scored.select("doc_id", "page_number", F.inline("hits")).select("doc_id", "section_id", "page_number", "score", "max_pages")


def section_scores(pages: DataFrame, sections: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, section_id, page_number, score, max_pages): pages that reach their section's minimum."""
    return scores_of(page_scores(pages, sections, rules))


def top_pages(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "section_id").orderBy(F.desc("score"), "page_number")
    return scores.withColumn("rn", F.row_number().over(w)).where("rn <= max_pages").select("doc_id", "section_id", "page_number")


def primary_section(sections: DataFrame) -> DataFrame:
    """One row: the section of least priority number, else the first."""
    return sections.agg(F.min_by("section_id", F.struct(F.coalesce("priority", F.lit(999)), "ordinal")).alias("section_id"))


def route_low_quality(sel: DataFrame, pages: DataFrame, sections: DataFrame, few: int = 10, most: int = 5) -> DataFrame:
    """Unreadable pages go to signature sections, then, where little was found, to the primary section."""
    low = pages.where(~(F.col("is_readable") & F.col("has_text"))).select("doc_id", "page_number")
    signing = sections.where("extract_signatures and search_last_pages").select("section_id", "max_pages")
    wanted = beside(low, signing).join(sel, ["doc_id", "section_id", "page_number"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("page_number"))
    one = sel.unionByName(wanted.withColumn("rn", rank).where("rn <= max_pages").select("doc_id", "section_id", "page_number"))
    enough = one.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n")).where(F.col("n") >= few).select("doc_id")
    first = low.join(enough, "doc_id", "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).where(F.col("rn") <= most)
    added = first.join(primary_section(sections), F.lit(True), "inner").select("doc_id", "section_id", "page_number")
    return one.unionByName(added).distinct()


def cover_uncovered(sel: DataFrame, pages: DataFrame, sections: DataFrame, share: float = 0.5, most: int = 50) -> DataFrame:
    """Small documents of which less than half is used: all unused readable pages go to the primary section."""
    used = sel.select("doc_id", "page_number").distinct()
    state = pages.join(used.withColumn("used", F.lit(1)), ["doc_id", "page_number"], "left")
    per_doc = Window.partitionBy("doc_id")
    state = state.withColumn("n_used", F.count("used").over(per_doc))
    readable = F.col("is_readable") & F.col("has_text")
    gap = state.where(readable & F.col("used").isNull() & (F.col("n_used") / F.col("total_pages") < share) & (F.col("total_pages") <= most))
    return sel.unionByName(gap.join(primary_section(sections), F.lit(True), "inner").select("doc_id", "section_id", "page_number")).distinct()


def dedup_across_sections(sel: DataFrame, sections: DataFrame) -> DataFrame:
    """Each page stays in the section of least priority number only."""
    ranked = sel.join(sections.select("section_id", F.coalesce("priority", F.lit(999)).alias("p"), "ordinal"), "section_id")
    w = Window.partitionBy("doc_id", "page_number").orderBy("p", "ordinal")
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "section_id", "page_number")


def expand_neighbours(sel: DataFrame, pages: DataFrame, sections: DataFrame, few: int = 5, long: int = 10) -> DataFrame:
    """Long documents with few pages found: the neighbours of those pages go to the primary section."""
    totals = pages.groupBy("doc_id").agg(F.max("total_pages").alias("total"))
    used = sel.groupBy("doc_id").agg(F.collect_set("page_number").alias("p")).join(totals, "doc_id").where((F.size("p") < few) & (F.col("total") > long))
    near = used.select("doc_id", "p", "total", F.explode(F.array_distinct(F.flatten(F.transform("p", lambda x: F.array(x - 1, x + 1))))).alias("page_number"))
    near = near.where((F.col("page_number") >= 1) & (F.col("page_number") <= F.col("total")) & ~F.array_contains("p", F.col("page_number")))
    return sel.unionByName(near.join(primary_section(sections), F.lit(True), "inner").select("doc_id", "section_id", "page_number"))


def select_pages(scored: DataFrame, sections: DataFrame) -> DataFrame:
    """Top pages of ``page_scores``, repairs and deduplication in turn."""
    sel = top_pages(scores_of(scored))
    sel = route_low_quality(sel, scored, sections)
    sel = cover_uncovered(sel, scored, sections)
    return dedup_across_sections(sel, sections)


def start_page_ranges(starts: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, start_page, end_page): each section runs to the next one's start; unknown
    sections take part in the order and are dropped afterwards. ``starts`` has doc_id, section_id, start_page, total_pages."""
    known = sections.select("section_id", "ordinal", "max_pages")
    rows = starts.join(known, "section_id", "left")
    following = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page", F.coalesce("ordinal", F.lit(999)), "section_id"))
    end = F.least(F.coalesce(following - 1, F.col("total_pages")), F.col("start_page") + F.col("max_pages") - 1)
    return rows.withColumn("end_page", end).where("ordinal is not null").select("doc_id", "section_id", "start_page", F.greatest("start_page", "end_page").alias("end_page"))


def extraction_plan(sel: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, section_pages): selected pages; all pages for the primary section where none was selected."""
    bare = pages.join(sel.select("doc_id").distinct(), "doc_id", "left_anti").join(primary_section(sections), F.lit(True), "inner").select("doc_id", "section_id", "page_number")
    return sel.unionByName(bare).groupBy("doc_id", "section_id").agg(F.sort_array(F.collect_set("page_number")).alias("section_pages"))


def plan_coverage(plan: DataFrame, pages: DataFrame) -> DataFrame:
    targeted = plan.select("doc_id", "section_id", F.explode("section_pages").alias("p")).groupBy("doc_id").agg(F.countDistinct("p").alias("targeted_pages"), F.countDistinct("section_id").alias("sections"))
    totals = pages.groupBy("doc_id").agg(F.max("total_pages").alias("total_pages"))
    return totals.join(targeted, "doc_id", "left").select("doc_id", F.coalesce("targeted_pages", F.lit(0)).alias("targeted_pages"), "total_pages", F.coalesce("sections", F.lit(0)).alias("sections"), (F.coalesce("targeted_pages", F.lit(0)) / F.col("total_pages")).alias("share"))


def classify_by_keywords(docs: DataFrame, sections: DataFrame, least: int = 3) -> DataFrame:
    """The section (as a type) with the most keywords in a document, with a confidence band.

    The sections come as one row, so a text is lowered and read once and never shuffled.
    """
    packed = sections.agg(F.collect_list(F.struct("ordinal", "section_id", "keywords")).alias("sections"))
    rows = docs.select("doc_id", F.lower("text").alias("low")).join(packed, F.lit(True), "inner")
    hits = F.transform("sections", lambda s: F.struct(_matches(s.keywords).alias("hits"), (-s.ordinal).alias("turn"), s.section_id.alias("section_id")))
    best = rows.select("doc_id", F.array_max(F.filter(hits, lambda h: h.hits >= least)).alias("b"))
    band = F.when(F.col("b.hits") >= 5, "high").when(F.col("b.hits").isNotNull(), "medium").otherwise("none")
    return best.select("doc_id", F.coalesce("b.section_id", F.lit("unknown")).alias("document_type"), F.coalesce("b.hits", F.lit(0)).alias("hits"), band.alias("confidence"))


def reclassify_if_empty(sel: DataFrame, docs: DataFrame, critical: list[str]) -> DataFrame:
    """Documents without a page in any critical section, or with at most one section, get another type."""
    seen = sel.groupBy("doc_id").agg(F.max(F.col("section_id").isin(critical).cast("int")).alias("has"), F.countDistinct("section_id").alias("n"))
    flag = (F.coalesce("has", F.lit(0)) == 0) | (F.coalesce("n", F.lit(0)) <= 1)
    return docs.select("doc_id").join(seen, "doc_id", "left").select("doc_id", F.when(flag, "loan_agreement").otherwise("credit_agreement").alias("document_type"))
