"""Compliance: choosing baselines, evaluating requirements, scores, reviews, feedback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.text import strip
from docspark.operators.shared import as_of, broadcast_if_small


def select_baselines(docs: DataFrame, baselines: DataFrame) -> DataFrame:
    """(doc_id, baseline_id): the published ones among those named, else the published ones of the plugin.

    ``docs`` has doc_id, plugin_id, baseline_ids; ``baselines`` has baseline_id, status, plugin_ids.
    """
    live = baselines.where("status = 'published'")
    named = docs.select("doc_id", F.explode("baseline_ids").alias("baseline_id")).join(live, "baseline_id").select("doc_id", "baseline_id").distinct()
    open_docs = docs.where(F.coalesce(F.size("baseline_ids"), F.lit(0)) <= 0)
    by_plugin = live.select("baseline_id", F.explode("plugin_ids").alias("plugin_id")).distinct()
    return named.unionByName(open_docs.join(by_plugin, "plugin_id").select("doc_id", "baseline_id"))


def requirement_batches(requirements: DataFrame, n: int = 10) -> DataFrame:
    """(baseline_id, requirement_id, batch) from baselines with their requirement lists."""
    return requirements.select("baseline_id", F.posexplode("requirement_ids").alias("pos", "requirement_id")).withColumn("batch", F.floor(F.col("pos") / n).cast("int"))


#: What stands between words, and the words of evidence on either side of a term.
BETWEEN, AROUND = r"[^\p{L}\p{N}]+", 8


def _words(c: Column) -> Column:
    return F.filter(F.split(c, BETWEEN), lambda w: w != "")


def _phrase(c: Column) -> Column:
    """A term in the form in which it is looked up: its words in lower case, one space apart."""
    return F.lower(F.array_join(_words(c), " "))


def _phrases(terms: str) -> Column:
    """The distinct terms of a list that have a word at all."""
    return F.filter(F.array_distinct(F.transform(terms, _phrase)), lambda t: t != "")


def _term_hits(requirements: DataFrame, pages: DataFrame) -> DataFrame:
    """(requirement_id, doc_id, page_number, term, pos, excerpt) of every place of a page where a requirement's
    term stands, word for word; a term may have several words. excerpt: the words around it.

    Pages meet terms by an equi-join on runs of words, of just the lengths that terms have. The terms are broadcast
    if they are few, so that runs that are no terms go before any shuffle; else the join is shuffled, and the
    pages' words join again where a term was found.
    """
    terms = requirements.select("requirement_id", F.explode(_phrases("terms")).alias("term")).distinct()
    sizes = sorted(r.n for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())
    words = pages.select("doc_id", "page_number", _words(F.col("text")).alias("words"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.lower(F.array_join(F.slice("words", i, n), " ")).alias("term")))

    runs = [runs_of(n) for n in sizes]
    runs = F.concat(*runs) if runs else F.array().cast("array<struct<pos:int,n:int,term:string>>")
    excerpt = F.array_join(F.slice("words", F.greatest(F.col("pos") - AROUND, F.lit(1)), F.least(F.col("pos") - 1, F.lit(AROUND)) + F.col("n") + AROUND), " ").alias("excerpt")
    known = broadcast_if_small(terms)
    if known is not terms:
        found = words.select("doc_id", "page_number", "words", F.explode(runs).alias("r")).select("doc_id", "page_number", "words", "r.*").join(known, "term")
    else:
        found = words.select("doc_id", "page_number", F.explode(runs).alias("r")).select("doc_id", "page_number", "r.*").join(terms, "term").join(words, ["doc_id", "page_number"])
    return found.select("requirement_id", "doc_id", "page_number", "term", "pos", excerpt)


def candidate_pages(requirements: DataFrame, pages: DataFrame) -> DataFrame:
    """(requirement_id, doc_id, page_number, found): pages that hold any of a requirement's terms."""
    return _term_hits(requirements, pages).groupBy("requirement_id", "doc_id", "page_number").agg(F.countDistinct("term").cast("int").alias("found"))


def keyword_evaluator(rows: DataFrame) -> DataFrame:
    """Verdicts by the share of terms found anywhere in the document: all is PASS, some PARTIAL, none NOT_FOUND."""
    found = F.coalesce("found", F.lit(0))
    verdict = F.when(found == 0, "NOT_FOUND").when(found == F.col("n_terms"), "PASS").otherwise("PARTIAL")
    return rows.withColumns({"verdict": verdict, "confidence": F.when(found > 0, found / F.col("n_terms")).otherwise(0.0)})


def evaluate_requirements(chosen: DataFrame, requirements: DataFrame, pages: DataFrame, evaluator: Callable[[DataFrame], DataFrame] = keyword_evaluator) -> DataFrame:
    """(doc_id, requirement_id, verdict, confidence, evidence, first_page, page_references): a row for every
    requirement of every baseline chosen for a document, whatever is found.

    ``chosen`` has doc_id, baseline_id; ``requirements`` has baseline_id, requirement_id, terms. Evidence is the
    text around the first place of any term, empty if none is found. ``evaluator`` adds verdict and confidence to
    rows of doc_id, requirement_id, n_terms, found, evidence, first_page and page_references; one that asks a
    model may do so in ``mapInPandas``.
    """
    wanted = requirements.select("baseline_id", "requirement_id", F.size(_phrases("terms")).alias("n_terms"))
    pairs = chosen.join(wanted, "baseline_id").select("doc_id", "requirement_id", "n_terms").distinct()
    hits = _term_hits(requirements, pages).groupBy("requirement_id", "doc_id").agg(
        F.countDistinct("term").alias("found"), F.min_by("excerpt", F.struct("page_number", "pos", "term")).alias("evidence"), F.min("page_number").alias("first_page"), F.sort_array(F.collect_set("page_number")).alias("page_references")
    )
    rows = pairs.join(hits, ["doc_id", "requirement_id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return evaluator(rows).select("doc_id", "requirement_id", "verdict", "confidence", "evidence", "first_page", "page_references")


def report_scores(verdicts: DataFrame) -> DataFrame:
    """(doc_id, baseline_id, overall_score): share of PASS among the applicable, half to even; 0 if none is."""
    n = F.count_if(F.col("verdict") != "NOT_APPLICABLE")
    passed = F.count_if(F.col("verdict") == "PASS")
    return verdicts.groupBy("doc_id", "baseline_id").agg(F.when(n == 0, 0).otherwise(F.bround(100.0 * passed / n, 0)).cast("int").alias("overall_score"))


def scores_with_missing(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents without any baseline have the score -1."""
    out = docs.select("doc_id").join(scores, "doc_id", "left")
    return out.select("doc_id", F.coalesce("baseline_id", F.lit("no_baselines")).alias("baseline_id"), F.coalesce("overall_score", F.lit(-1)).alias("overall_score"))


def document_score(reports: DataFrame) -> DataFrame:
    """The score of the report stored last."""
    return reports.groupBy("doc_id").agg(F.max_by("overall_score", F.struct("evaluated_at", "seq")).alias("compliance_score"))


def apply_reviews(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides set on their verdicts; one for an unknown requirement becomes a row. The last of several counts."""
    last = overrides.groupBy("report_id", "requirement_id").agg(F.max_by(F.struct("corrected_verdict", "reviewer_note"), "seq").alias("o"))
    out = verdicts.join(last, ["report_id", "requirement_id"], "full")
    return out.select("report_id", "requirement_id", F.col("verdict"), F.col("o.corrected_verdict").alias("reviewer_override"), F.col("o.reviewer_note").alias("reviewer_note"), F.coalesce("o.corrected_verdict", "verdict").alias("effective_verdict"))


def reviewed_reports(reports: DataFrame, overrides: DataFrame) -> DataFrame:
    """(report_id, status, overall_score): a report with an override is reviewed; its score stays."""
    touched = overrides.select("report_id", F.lit(True).alias("touched")).distinct()
    return reports.join(touched, "report_id", "left").select("report_id", F.when(F.col("touched"), "reviewed").otherwise(F.col("status")).alias("status"), "overall_score")


def feedback_from_reviews(reviewed: DataFrame) -> DataFrame:
    return reviewed.where("reviewer_override is not null").select("requirement_id", F.col("verdict").alias("original_verdict"), F.col("reviewer_override").alias("corrected_verdict"), "reviewer_note")


def recent_corrections(feedback: DataFrame, per_requirement: int = 3, per_batch: int = 5) -> DataFrame:
    """(batch, lines): the newest corrections of each requirement, of those the newest of each batch."""
    w = lambda k: Window.partitionBy(k).orderBy(F.desc("created_at"), F.desc("feedback_id"))
    top = feedback.withColumn("r", F.row_number().over(w("requirement_id"))).where(F.col("r") <= per_requirement)
    top = top.withColumn("r", F.row_number().over(w("batch"))).where(F.col("r") <= per_batch)
    line = F.concat_ws(" ", "requirement_id", "original_verdict", F.lit("->"), "corrected_verdict")
    return top.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))


def verdict_cube(verdicts: DataFrame) -> DataFrame:
    """Counts and pass rates by baseline, category and criticality, with all subtotals."""
    n = F.count_if(F.col("verdict") != "NOT_APPLICABLE")
    out = verdicts.cube("baseline_id", "category", "criticality").agg(F.count("*").alias("verdicts"), F.count_if(F.col("verdict") == "PASS").alias("passed"), n.alias("applicable"), F.grouping_id().cast("int").alias("level"))
    return out.select("baseline_id", "category", "criticality", "verdicts", "passed", "level", F.when(F.col("applicable") > 0, F.round(F.col("passed") / F.col("applicable"), 6)).alias("pass_rate"))


#: Words that make a sentence a requirement.
OBLIGATIONS = ["must", "shall", "required", "at least", "at most", "no later than", "prohibited"]


#: A run of text between stops, or a run of stops.
PIECE = r"[^.!?\n]+|[.!?\n]+"


def _obliging(text: Column, pattern: str) -> Column:
    """The sentences of a text that oblige, with their number and their place: one pass along the text's pieces."""
    kind = "array<struct<seq:int,start:int,chars:int,text:string>>"

    def step(s: Column, piece: Column) -> Column:
        stop, low = piece.rlike(r"^[.!?\n]"), F.lower(piece)
        own = F.struct(s.seq.alias("seq"), s.at.alias("start"), F.length(piece).alias("chars"), piece.alias("text"))
        found = F.when(~stop & low.rlike(pattern), F.concat(s.found, F.array(own))).otherwise(s.found)
        return F.struct((s.at + F.length(piece)).alias("at"), (s.seq + stop.cast("int")).alias("seq"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seq"), F.array().cast(kind).alias("found"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), start, step, lambda s: s.found)


def extract_requirements(docs: DataFrame, words: list[str] | None = None, pages: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, text, category, criticality, confidence_threshold, status) of sentences that oblige.

    With ``pages`` (doc_id, page_number, text; a document's pages in order are its text) also first_page and
    last_page, and with ``nodes`` too (doc_id, title, start_index; see ``leaf_sections``) source_section: the title
    of the last node that starts on the first page or before, null before the first. Sentences, page starts and
    node starts are merged in their order; no range is joined.
    """
    pattern = r"(^|[^\p{L}])(" + "|".join(words or OBLIGATIONS) + r")([^\p{L}]|$)"
    found = docs.select("doc_id", F.explode(_obliging(F.col("text"), pattern)).alias("r")).select("doc_id", "r.seq", "r.start", "r.chars", strip(F.col("r.text")).alias("text"))
    defaults = [F.lit("General").alias("category"), F.lit("should-have").alias("criticality"), F.lit(0.8).alias("confidence_threshold"), F.lit("active").alias("status")]
    if pages is None:
        return found.select("doc_id", "seq", "text", *defaults)
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("doc_id", "page_number", F.length("text").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = as_of(found.withColumn("at", F.col("start")), starts.where("n > 0"), "page_number", "first_page")
    found = as_of(found.withColumn("at", F.col("start") + F.col("chars") - 1), starts.where("n > 0"), "page_number", "last_page")
    extra = ["first_page", "last_page"]
    if nodes is not None:
        begins = nodes.groupBy("doc_id", F.col("start_index").alias("at")).agg(F.max_by("title", "seq").alias("title"))
        found = as_of(found.withColumn("at", F.col("first_page")), begins, "title", "source_section")
        extra.append("source_section")
    return found.select("doc_id", "seq", "text", *defaults, *extra)


def append_requirements(baselines: DataFrame, new: DataFrame) -> DataFrame:
    """Baselines (baseline_id, categories, requirements, sources) with new rows (baseline_id, category, text, source) appended."""
    add = new.groupBy("baseline_id").agg(F.sort_array(F.collect_list(F.struct("text", "category"))).alias("add"), F.sort_array(F.collect_set("source")).alias("src"))
    out = baselines.join(add, "baseline_id", "left")
    part = lambda name: F.coalesce(F.transform("add", lambda x: x[name]), F.expr("cast(array() as array<string>)"))
    return out.select(
        "baseline_id",
        F.array_sort(F.array_union("categories", part("category"))).alias("categories"),
        F.concat("requirements", part("text")).alias("requirements"),
        F.concat("sources", F.coalesce("src", F.expr("cast(array() as array<string>)"))).alias("sources"),
    )


#: The attributes of a requirement that may be edited.
EDITABLE = ["text", "category", "criticality", "confidence_threshold", "status"]


def edit_requirements(baselines: DataFrame, ops: DataFrame) -> DataFrame:
    """(baseline_id, requirement_id, attributes, rejected): adds, updates and deletes by id; an unknown id is rejected.

    ``baselines`` is one row a requirement: baseline_id, requirement_id and those of ``EDITABLE`` that it has;
    ``ops`` has op, seq and the attributes to set, null where one stays as it is. The last op of a requirement counts.
    """
    names = [c for c in EDITABLE if c in baselines.columns]
    given = [c for c in names if c in ops.columns]
    last = ops.groupBy("baseline_id", "requirement_id").agg(F.max_by(F.struct("op", *given), "seq").alias("o"))
    both = baselines.withColumn("known", F.lit(True)).join(last, ["baseline_id", "requirement_id"], "full")
    unknown = F.col("known").isNull() & (F.col("o.op") != "add")
    kept = both.where(unknown | (F.coalesce("o.op", F.lit("keep")) != "delete"))
    edited = lambda c: F.when(F.col("o.op").isin("update", "add"), F.coalesce(f"o.{c}", c)).otherwise(F.col(c))
    return kept.select("baseline_id", "requirement_id", *((edited(c) if c in given else F.col(c)).alias(c) for c in names), unknown.alias("rejected"))


def baseline_lifecycle(baselines: DataFrame, ops: DataFrame) -> DataFrame:
    """(baseline_id, status, version) after publish (needs a requirement, adds 1) or archive."""
    last = ops.groupBy("baseline_id").agg(F.max_by("op", "seq").alias("op"))
    out = baselines.join(last, "baseline_id", "left")
    publish = (F.col("op") == "publish") & (F.col("n_requirements") > 0)
    status = F.when(publish, "published").when(F.col("op") == "archive", "archived").otherwise(F.col("status"))
    return out.select("baseline_id", status.alias("status"), (F.col("version") + F.when(publish, 1).otherwise(0)).alias("version"))
