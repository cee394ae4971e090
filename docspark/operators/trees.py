"""Section trees of documents, kept flat: one row a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.operators.shared import beside


def heading_entries(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line, structure, title) of lines that begin with a number like 1.2.

    Only a line feed ends a line, and white space is that of SQL's patterns: other separators belong to the title.
    """
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    pattern = r"(?s)^[\t\n\f\r ]*(\d+(?:\.\d+)*)\.?[\t\n\f\r ]+([^\t\n\f\r ].*)$"
    return rows.where(F.col("l").rlike(pattern)).select("doc_id", "page_number", "line", F.regexp_extract("l", pattern, 1).alias("structure"), F.regexp_extract("l", pattern, 2).alias("title"))


def is_contents(text: Column) -> Column:
    """Whether a page is a table of contents, by its lines: some end in a page number behind leaders of dots, or
    at least three and half of them end in numbers that never fall, or its heading says so and some do."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    ends = F.filter(lines, lambda x: x.rlike(r"\p{L}.*[ .\x{2026}]\d{1,4}$"))
    leaders = F.filter(ends, lambda x: x.rlike(r"(?:\. ?){3,}\d{1,4}$|\x{2026} ?\d{1,4}$"))
    numbers = F.transform(ends, lambda x: F.regexp_extract(x, r"(\d{1,4})$", 1).cast("int"))
    listed = (F.size(ends) >= 3) & (2 * F.size(ends) >= F.size(lines)) & (F.array_sort(numbers) == numbers)
    headed = F.lower(F.element_at(F.slice(lines, 1, 1), 1)).rlike(r"^(?:table of )?contents\.?:?$") & (F.size(ends) > 0)
    return F.coalesce((F.size(leaders) >= 2) | listed | F.when(F.size(lines) > 0, headed), F.lit(False))


def page_offset(entries: DataFrame, pages: DataFrame, first: int = 10) -> DataFrame:
    """(doc_id, page_shift, confident): among a document's first entries the first that is found on a page
    near its printed one. ``entries`` has doc_id, seq, title, printed_page; the range is -5 to 29. Contents
    pages, which hold every title, do not count."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    e = entries.withColumn("k", rank).where((F.col("k") <= first) & F.col("printed_page").isNotNull())
    e = e.withColumn("key", F.substring(F.trim(F.lower("title")), 1, 40)).where("key <> ''")
    tried = e.select("doc_id", "k", "key", "printed_page", F.explode(F.sequence(F.lit(-5), F.lit(29))).alias("page_shift")).withColumn("page_number", F.col("printed_page") + F.col("page_shift"))
    texts = pages.where(~is_contents(F.col("text"))).select("doc_id", "page_number", F.lower("text").alias("t"))
    found = tried.join(texts, ["doc_id", "page_number"]).where(F.contains("t", F.col("key")))
    best = found.groupBy("doc_id").agg(F.min(F.struct("k", "page_shift")).alias("b"))
    return entries.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("b.page_shift", F.lit(0)).alias("page_shift"), F.col("b").isNotNull().alias("confident"))


def apply_offset(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    return entries.join(offsets, "doc_id").withColumn("physical_page", F.col("printed_page") + F.col("page_shift"))


def locate_titles(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, seq, physical_page): the first page that holds an unlocated entry's title.

    A document's titles travel as one array, so each page meets them once.
    """
    e = entries.where("physical_page is null").select("doc_id", "seq", F.trim(F.lower("title")).alias("key")).where("key <> ''")
    titles = e.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "key")).alias("titles"))
    both = pages.select("doc_id", "page_number", F.lower("text").alias("t")).join(titles, "doc_id")
    held = F.transform(F.filter("titles", lambda x: F.contains(F.col("t"), x.key)), lambda x: x.seq)
    return both.select("doc_id", "page_number", F.explode(held).alias("seq")).groupBy("doc_id", "seq").agg(F.min("page_number").alias("physical_page"))


def _by_level(nodes: DataFrame, first) -> DataFrame:
    """``nodes`` once for each level from ``first`` to the deepest of their document, and ``own``: whether it is
    the row of the node's own depth. Rows of one level can be compared by windows, whatever the depth."""
    deepest = F.max("depth").over(Window.partitionBy("doc_id"))
    levels = F.when(first <= F.col("deepest"), F.sequence(first, F.col("deepest"))).otherwise(F.array().cast("array<int>"))
    rows = nodes.withColumn("deepest", deepest).withColumn("level", F.explode(F.array_union(F.array("depth"), levels)))
    return rows.withColumn("own", F.col("level") == F.col("depth")).drop("deepest")


def tree_parents(entries: DataFrame) -> DataFrame:
    """(doc_id, seq, parent, depth, title, start_index): order by page, then structure as text; the parent
    is the nearest earlier entry of smaller depth. Any depth."""
    depth = F.length("structure") - F.length(F.regexp_replace("structure", r"\.", ""))
    order = Window.partitionBy("doc_id").orderBy("physical_page", "structure", "entry_id")
    rows = entries.select("doc_id", "title", F.col("physical_page").alias("start_index"), depth.alias("depth"), F.row_number().over(order).alias("seq"))
    # An entry stands for a parent on every level below its own.
    before = Window.partitionBy("doc_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.max(F.when(~F.col("own"), F.col("seq"))).over(before)
    return _by_level(rows, F.col("depth") + 1).withColumn("parent", parent).where("own").select("doc_id", "seq", "parent", "depth", "title", "start_index")


def node_ids(nodes: DataFrame) -> DataFrame:
    """Zero-padded preorder numbers from 0; preorder is the order of the entries."""
    return nodes.withColumn("node_id", F.lpad((F.col("seq") - 1).cast("string"), 4, "0"))


def tree_end_pages(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(…, end_index): before the next sibling's start, for the last sibling the parent's end.

    In preorder that is the page before the first later node of no greater depth, which follows the
    node's whole subtree, so one pass of windows settles all levels.
    """
    after = Window.partitionBy("doc_id", "level").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = _by_level(nodes.select("doc_id", "seq", "parent", "depth", "title", "start_index"), F.col("depth"))
    rows = rows.withColumn("following", F.min("start_index").over(after)).where("own").join(totals, "doc_id")
    end = F.greatest("start_index", F.coalesce(F.col("following") - 1, F.col("total_pages")))
    return rows.select("doc_id", "seq", "parent", "depth", "title", "start_index", end.alias("end_index"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("top_level"), F.max("depth").alias("max_depth"), F.max("end_index").alias("last_page"))


def oversized_leaves(nodes: DataFrame, pages: DataFrame, most_pages: int = 10, most_tokens: int = 20000) -> DataFrame:
    """Leaves with too many pages or tokens; ``pages`` has tokens."""
    leaves = nodes.join(nodes.select("doc_id", F.col("parent").alias("seq")).where("seq is not null").distinct(), ["doc_id", "seq"], "left_anti")
    each = leaves.select("doc_id", "seq", "start_index", "end_index", F.explode(F.sequence("start_index", "end_index")).alias("page_number"))
    sized = each.join(pages.select("doc_id", "page_number", "tokens"), ["doc_id", "page_number"], "left").groupBy("doc_id", "seq").agg(F.count("*").alias("pages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return sized.where((F.col("pages") > most_pages) | (F.col("tokens") > most_tokens))


def split_oversized(nodes: DataFrame, oversized: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, leaf, seq, parent, depth, title, start_index, end_index): the headings found inside the pages of
    oversized leaves, as trees of their own under each leaf; the last sibling ends where the leaf ends.

    ``headings`` has doc_id, entry_id, structure, title, page_number. Leaves without a heading give no row
    and stay as they are. A leaf's tree is built as a document of its own, so all leaves are split at once.
    """
    leaves = oversized.select("doc_id", F.col("seq").alias("leaf")).join(nodes.select("doc_id", F.col("seq").alias("leaf"), "start_index", "end_index"), ["doc_id", "leaf"])
    within = leaves.join(headings, "doc_id").where(F.col("page_number").between(F.col("start_index"), F.col("end_index")))
    key = F.struct("doc_id", "leaf").alias("doc_id")
    entries = within.select(key, "entry_id", "structure", "title", F.col("page_number").alias("physical_page"))
    trees = tree_end_pages(tree_parents(entries), leaves.select(key, F.col("end_index").alias("total_pages")))
    return trees.select("doc_id.doc_id", "doc_id.leaf", "seq", "parent", "depth", "title", "start_index", "end_index")


def verify_headings(entries: DataFrame, pages: DataFrame, n: int = 15) -> DataFrame:
    """(doc_id, checked, share): share of a fixed sample of entries whose title stands at the top of its page."""
    w = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("entry_id").cast("string"))))
    sample = entries.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    hit = sample.join(pages.select("doc_id", F.col("page_number").alias("physical_page"), F.lower(F.substring("text", 1, 2000)).alias("t")), ["doc_id", "physical_page"])
    return hit.groupBy("doc_id").agg(F.count("*").alias("checked"), F.avg(F.contains("t", F.trim(F.lower("title"))).cast("int")).alias("share"))


def node_pages(nodes: DataFrame, span: int = 4, cap: int = 15) -> DataFrame:
    """(doc_id, seq, page_number): each node's first pages, and of a document's pages the first ``cap``."""
    rows = nodes.select("doc_id", "seq", F.explode(F.sequence("start_index", F.least("end_index", F.col("start_index") + span))).alias("page_number"))
    return rows.withColumn("r", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_number"))).where(F.col("r") <= cap).drop("r")


def compact_outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, outline): indented lines ``[id] title (p.a-b)``."""
    pages = F.when(F.col("start_index") == F.col("end_index"), F.concat(F.lit("p."), F.col("start_index").cast("string"))).otherwise(F.concat(F.lit("p."), F.col("start_index").cast("string"), F.lit("-"), F.col("end_index").cast("string")))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), F.lpad((F.col("seq") - 1).cast("string"), 4, "0"), F.lit("] "), "title", F.lit(" ("), pages, F.lit(")"))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x.l), "\n").alias("outline"))


def leaf_sections(nodes: DataFrame, level: int = 2) -> DataFrame:
    """Nodes at the given level, and those above it without children."""
    parents = nodes.select("doc_id", F.col("parent").alias("seq"), F.lit(True).alias("has")).where("seq is not null").distinct()
    return nodes.join(parents, ["doc_id", "seq"], "left").where((F.col("depth") == level) | ((F.col("depth") < level) & F.col("has").isNull())).drop("has")


def match_sections_to_nodes(nodes: DataFrame, sections: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, section_id, seq, score): 3 for each keyword in the title, else 1 for one in the summary."""
    both = beside(nodes, sections.select("section_id", "keywords"))
    title, summary = F.lower("title"), F.lower(F.coalesce("summary", F.lit("")))
    score = F.aggregate("keywords", F.lit(0), lambda a, k: a + F.when(F.contains(title, F.lower(k)), 3).when(F.contains(summary, F.lower(k)), 1).otherwise(0))
    return both.withColumn("score", score).where(F.col("score") >= least).select("doc_id", "section_id", "seq", "score")


def plan_from_tree(nodes: DataFrame, sections: list[tuple], section_table: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, section_id, page_number): sections claim their nodes' pages in turn, each at most max_pages
    of those that no earlier one kept; then sections with a last-pages rule take unclaimed last pages.

    ``sections``: (section_id, max_pages, takes_last) in order of the configuration: a few rows.
    """
    matched = match_sections_to_nodes(nodes, section_table).join(nodes.select("doc_id", "seq", "start_index", "end_index"), ["doc_id", "seq"])
    wanted = matched.select("doc_id", "section_id", F.explode(F.sequence("start_index", "end_index")).alias("page_number")).distinct()
    # A document's claims are folded over its sections in order: a small native fold, no loop of joins.
    by_section = wanted.groupBy("doc_id", "section_id").agg(F.sort_array(F.collect_list("page_number")).alias("p"))
    per_doc = by_section.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_id", "p"))).alias("m"))
    rows = totals.join(per_doc, "doc_id", "left")
    none = F.expr("cast(array() as array<int>)")
    used, out = none, []
    for name, most, _ in sections:
        own = F.slice(F.array_except(F.coalesce(F.try_element_at("m", F.lit(name)), none), F.col("used")), 1, most)
        rows = (rows if out else rows.withColumn("used", used)).withColumn(f"p_{name}", own).withColumn("used", F.concat("used", F.col(f"p_{name}")))
        out.append(name)
    for name, most, takes_last in sections:
        if takes_last:
            last = F.sequence(F.greatest(F.lit(1), F.col("total_pages") - most + 1), F.col("total_pages"))
            rows = rows.withColumn(f"p_{name}", F.when(F.size(f"p_{name}") == 0, F.array_except(last, F.col("used"))).otherwise(F.col(f"p_{name}"))).withColumn("used", F.array_union("used", F.col(f"p_{name}")))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("section_id"), F.col(f"p_{n}").alias("p")) for n in out)))
    return rows.select("doc_id", each.alias("e")).select("doc_id", "e.section_id", F.explode("e.p").alias("page_number"))


def tree_cost(stats: DataFrame) -> DataFrame:
    p = F.col("pages")
    tokens_in, tokens_out = 500 * F.least(p, F.lit(20)) + 500 * p + 7500, 200 + 100 * p + 750
    return stats.select("doc_id", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), F.round(tokens_in / 1e6 + tokens_out * 5 / 1e6, 6).alias("cost"))


def cache_summaries(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """A node's cached summary wins over a new one."""
    return nodes.join(summaries.select("doc_id", "seq", F.col("summary").alias("new")), ["doc_id", "seq"], "left").withColumn("summary", F.coalesce("summary", "new")).drop("new")
