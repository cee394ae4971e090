"""Queries of the compliance and workflow operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import compliance as C
from docspark.operators import pages as P
from docspark.operators import workflow as W
from docspark.operators.shared import spread


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf):
    """Events by document (the user): each type is a stage, an error is a failure."""
    return events_of(_t(spark, sf, "events"))


def events_of(e):
    kinds = {"view": "router", "click": "extractor", "purchase": "normalizer", "signup": "compliance"}
    stage = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("router"))
    v = F.floor("value").cast("int")
    text = F.when(F.col("event_type") == "error", "stage failed").when(F.col("event_type") == "view", F.concat(F.lit("Classified as type_"), (v % 5).cast("string"), F.lit(" (confidence: "), F.when(v > 20, "high").otherwise("low"), F.lit(")")))
    text = text.when(F.col("event_type") == "click", F.concat(F.lit("Targeted "), v.cast("string"), F.lit("/"), (v + 7).cast("string"), F.lit(" pages across "), (v % 4).cast("string"), F.lit(" sections"))).otherwise(F.concat(F.lit("step "), v.cast("string")))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("document_id"), stage.alias("stage"), text.alias("message"), "value", "event_type")


EVENTS = """ev AS (SELECT event_id, ts, user_id AS document_id, CASE event_type WHEN 'click' THEN 'extractor' WHEN 'purchase' THEN 'normalizer' WHEN 'signup' THEN 'compliance' ELSE 'router' END AS stage,
  CASE event_type WHEN 'error' THEN 'stage failed' WHEN 'view' THEN 'Classified as type_' || floor(value)::INT % 5 || ' (confidence: ' || CASE WHEN floor(value)::INT > 20 THEN 'high' ELSE 'low' END || ')'
    WHEN 'click' THEN 'Targeted ' || floor(value)::INT || '/' || floor(value)::INT + 7 || ' pages across ' || floor(value)::INT % 4 || ' sections' ELSE 'step ' || floor(value)::INT END AS message, value, event_type FROM events)"""


def _docs(spark, sf):
    o = _t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSED")
    review = F.when(F.col("o_orderpriority").startswith("1"), "APPROVED").when(F.col("o_orderpriority").startswith("2"), "REJECTED").otherwise("PENDING_REVIEW")
    return o.select(F.col("o_orderkey").alias("document_id"), status.alias("status"), review.alias("review_status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"), F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("file_name"), F.concat(F.lit("type_"), (F.col("o_custkey") % 3).cast("string")).alias("document_type"), (F.col("o_custkey") % 4).cast("int").alias("version"))


DOCS = """docs AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PENDING' ELSE 'PROCESSED' END AS status,
  CASE o_orderpriority[1] WHEN '1' THEN 'APPROVED' WHEN '2' THEN 'REJECTED' ELSE 'PENDING_REVIEW' END AS review_status, o_orderdate AS created_at, o_totalprice AS cost, 'file-' || o_custkey AS file_name, 'type_' || o_custkey % 3 AS document_type, (o_custkey % 4)::INT AS version FROM orders)"""


def _verdicts(spark, sf):
    verdict = F.when(F.col("l_partkey") % 10 == 0, "NOT_APPLICABLE").when((F.col("l_returnflag") == "A"), "PASS").when(F.col("l_linestatus") == "F", "FAIL").otherwise("PARTIAL")
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 4).cast("string").alias("baseline_id"), F.col("l_linenumber").cast("string").alias("requirement_id"), verdict.alias("verdict"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("category"), F.when(F.col("l_quantity") > 25, "must-have").otherwise("should-have").alias("criticality"), F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("supp"), "l_extendedprice")


VERDICTS = """vd AS (SELECT l_orderkey AS doc_id, (l_suppkey % 4)::VARCHAR AS baseline_id, l_linenumber::VARCHAR AS requirement_id, CASE WHEN l_partkey % 10 = 0 THEN 'NOT_APPLICABLE' WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_linestatus = 'F' THEN 'FAIL' ELSE 'PARTIAL' END AS verdict,
  'c' || l_partkey % 3 AS category, CASE WHEN l_quantity > 25 THEN 'must-have' ELSE 'should-have' END AS criticality, l_partkey AS seq, l_suppkey AS supp, l_extendedprice FROM lineitem)"""


def compliance_baselines(spark, sf):
    c = _t(spark, sf, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 1000).cast("string")).alias("plugin_id"), F.when(F.col("c_custkey") % 3 == 0, F.array((F.col("c_custkey") % 7).cast("string"), F.lit("1"))).otherwise(F.expr("cast(array() as array<string>)")).alias("baseline_ids"))
    s = _t(spark, sf, "supplier")
    baselines = s.select(F.col("s_suppkey").cast("string").alias("baseline_id"), F.when(F.col("s_suppkey") % 3 == 2, "draft").otherwise("published").alias("status"), F.array(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")), F.concat(F.lit("p"), (F.col("s_suppkey") + 1).cast("string"))).alias("plugin_ids"))
    return C.select_baselines(docs, baselines)


def requirement_batches(spark, sf):
    b = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("baseline_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("requirement_ids"))
    return C.requirement_batches(b).select("baseline_id", "requirement_id", "batch")


def _requirements(spark, sf):
    """Items as requirements of four baselines; their longer words and two phrases of theirs are the terms."""
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    k = F.col("item_id")
    longer = F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) > 5))
    phrases = F.array(F.concat_ws(", ", F.slice(words, 1, 2)), F.array_join(F.slice(words, 3, 3), " - "), F.lit("..."))
    return _t(spark, sf, "benchmark").select(F.concat(F.lit("b"), (k % 4).cast("string")).alias("baseline_id"), k.cast("string").alias("requirement_id"), F.concat(longer, phrases).alias("terms"))


REQS = r"""rw AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
  rq AS (SELECT item_id::VARCHAR AS requirement_id, 'b' || item_id % 4 AS baseline_id, list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) > 5) || list_filter([lower(array_to_string(w[1:2], ' ')), lower(array_to_string(w[3:5], ' '))], lambda x: x <> '')) AS terms FROM rw), req AS (SELECT requirement_id, unnest(terms) AS term FROM rq)"""
PAGES = "pg AS (SELECT doc_id, p::INT AS page_number, substr(t, ((p - 1) * 1500 + 1)::BIGINT, 1500) AS text FROM (SELECT doc_id, coalesce(text, '') AS t, greatest(1, ceil(length(coalesce(text, '')) / 1500.0))::BIGINT AS n FROM documents) d, LATERAL (SELECT unnest(range(1, n + 1)) AS p) u)"
WORDS = r"""pw AS (SELECT doc_id, page_number, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM pg), pi AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM pw),
  wd AS (SELECT doc_id, page_number, i, w, n, lower(array_to_string(w[i:i + n - 1], ' ')) AS term FROM pi, (VALUES (1), (2), (3)) v(n) WHERE i + n - 1 <= len(w))"""


def candidate_pages(spark, sf):
    return C.candidate_pages(_requirements(spark, sf), P.paginate(spread(_t(spark, sf, "documents").select("doc_id", "text"))))


def evaluate_requirements(spark, sf):
    docs = _t(spark, sf, "documents")
    chosen = docs.select("doc_id", F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("baseline_id"))
    out = C.evaluate_requirements(chosen, _requirements(spark, sf), P.paginate(spread(docs.select("doc_id", "text"))))
    return out.withColumns({"confidence": F.round("confidence", 6), "page_references": F.coalesce(F.array_join(F.transform("page_references", lambda p: p.cast("string")), ","), F.lit(""))})


def report_scores(spark, sf):
    return C.report_scores(_verdicts(spark, sf))


def scores_with_missing(spark, sf):
    docs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return C.scores_with_missing(docs, C.report_scores(_verdicts(spark, sf)))


def document_score(spark, sf):
    s = C.report_scores(_verdicts(spark, sf)).join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("evaluated_at")), "doc_id")
    return C.document_score(s.withColumn("seq", F.col("baseline_id")))


def _overrides(spark, sf):
    return _verdicts(spark, sf).where("seq % 5 = 1").select(F.col("doc_id").alias("report_id"), F.when(F.col("seq") % 2 == 0, F.col("requirement_id")).otherwise(F.concat("requirement_id", F.lit("x"))).alias("requirement_id"), F.when(F.col("supp") % 2 == 0, "PASS").otherwise("FAIL").alias("corrected_verdict"), F.concat(F.lit("note "), F.col("supp").cast("string")).alias("reviewer_note"), F.struct("seq", "supp", "l_extendedprice").alias("seq"))


def apply_reviews(spark, sf):
    v = _verdicts(spark, sf).groupBy(F.col("doc_id").alias("report_id"), "requirement_id").agg(F.max_by("verdict", F.struct("seq", "supp", "l_extendedprice")).alias("verdict"))
    return C.apply_reviews(v, _overrides(spark, sf))


def feedback_from_reviews(spark, sf):
    return C.feedback_from_reviews(apply_reviews(spark, sf)).groupBy("requirement_id", "original_verdict", "corrected_verdict").agg(F.count("*").alias("n"))


def recent_corrections(spark, sf):
    e = _events(spark, sf).where("event_type = 'error'")
    v = F.floor("value").cast("int")
    fb = e.select(F.col("event_id").alias("feedback_id"), F.concat(F.lit("r"), (v % 20).cast("string")).alias("requirement_id"), F.lit("FAIL").alias("original_verdict"), F.when(v % 2 == 0, "PASS").otherwise("PARTIAL").alias("corrected_verdict"), F.col("ts").alias("created_at"), F.floor((v % 20) / 10).cast("int").alias("batch"))
    return C.recent_corrections(fb)


def verdict_cube(spark, sf):
    return C.verdict_cube(_verdicts(spark, sf))


def extract_requirements(spark, sf):
    """Sentences with common words, on pages of 1500 characters; every third page begins a section."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    pages = P.paginate(docs)
    nodes = pages.where("page_number % 3 = 2").select("doc_id", F.col("page_number").alias("seq"), F.concat(F.lit("part "), F.col("page_number").cast("string")).alias("title"), F.col("page_number").alias("start_index"))
    out = C.extract_requirements(docs, ["that", "not", "für", "sur"], pages, nodes)
    return out.select("doc_id", "seq", F.md5("text").alias("text_md5"), "category", "criticality", "first_page", "last_page", "source_section")


def append_requirements(spark, sf):
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("baseline_id"), F.array(F.lit("General"), F.lit("c1")).alias("categories"), F.array("s_name").alias("requirements"), F.expr("cast(array() as array<string>)").alias("sources"))
    new = _verdicts(spark, sf).select(F.col("supp").alias("baseline_id"), "category", F.concat_ws("-", "requirement_id", F.col("seq").cast("string")).alias("text"), F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source"))
    out = C.append_requirements(b, new)
    return out.select("baseline_id", *(F.array_join(c, ",").alias(c) for c in ("categories", "requirements", "sources")))


def edit_requirements(spark, sf):
    base = _t(spark, sf, "part").select((F.col("p_partkey") % 10).alias("baseline_id"), F.col("p_partkey").alias("requirement_id"), F.col("p_name").alias("text"), F.lit("General").alias("category"))
    op = F.when(F.col("l_quantity") < 17, "delete").when(F.col("l_quantity") < 34, "update").otherwise("add")
    part = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))  # the negative ones are unknown
    ops = _t(spark, sf, "lineitem").select((F.col("l_partkey") % 10).alias("baseline_id"), part.alias("requirement_id"), op.alias("op"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("t"), F.col("l_linenumber").cast("string"))).alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "Credit").alias("category"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"))
    return C.edit_requirements(base, ops)


def baseline_lifecycle(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("baseline_id"), F.lit("draft").alias("status"), F.lit(0).alias("version"), (F.col("s_suppkey") % 3).alias("n_requirements"))
    ops = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("baseline_id"), F.when(F.col("l_linenumber") % 2 == 0, "publish").otherwise("archive").alias("op"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))
    return C.baseline_lifecycle(s, ops)


def list_documents(spark, sf):
    return W.list_documents(_docs(spark, sf), "PENDING", 100, 50).select("document_id", "status")


def status_metrics(spark, sf):
    return W.status_metrics(_docs(spark, sf))


def review_queue(spark, sf):
    return W.review_queue(_docs(spark, sf), "PENDING_REVIEW").select("document_id", "created_at")


def work_queue(spark, sf):
    """The queue in all its orders."""
    docs = _docs(spark, sf)
    parts = [W.work_queue(docs, "file-1", "type_1", sort).withColumn("sort", F.lit(sort)) for sort in ("attention", "newest", "oldest", "cost")]
    return reduce(DataFrame.unionByName, parts)


def merge_pending(spark, sf):
    d = _docs(spark, sf)
    return W.merge_pending(d.where("document_id % 3 <> 0"), d.where("document_id % 2 = 0"))


def stage_status(spark, sf):
    return W.stage_status(_events(spark, sf))


def stage_elapsed(spark, sf):
    return W.stage_elapsed(_events(spark, sf))


def latest_event(spark, sf):
    return W.latest_event(_events(spark, sf))


def parse_progress(spark, sf):
    return W.parse_progress(_events(spark, sf))


def section_events(events):
    action = F.when(F.col("event_type").isin("view", "click"), "start").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("skip")
    return events.select("document_id", F.concat(F.lit("s"), (F.floor("value") % 30).cast("string")).alias("section_id"), action.alias("action"), "ts", "event_id")


def section_progress(spark, sf):
    return W.section_progress(section_events(_events(spark, sf)))


def _actions(spark, sf):
    """Line items as review actions: some for other versions, some without notes, some unknown, some on no document."""
    kind = F.when(F.col("l_quantity") < 14, "approve").when(F.col("l_quantity") < 27, "reject").when(F.col("l_quantity") < 39, "correct").when(F.col("l_quantity") < 45, "reprocess").otherwise("archive")
    document = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return _t(spark, sf, "lineitem").select(document.alias("document_id"), kind.alias("action"), (F.col("l_linenumber") - 1).cast("int").alias("expected_version"), F.when(F.col("l_tax") > 0.02, "why").when(F.col("l_tax") > 0.01, " ").alias("notes"), F.col("l_shipdate").alias("ts"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("action_id"))


def apply_review_actions(spark, sf):
    return W.apply_review_actions(_docs(spark, sf), _actions(spark, sf))


def rejected_actions(spark, sf):
    out = W.rejected_actions(_docs(spark, sf), _actions(spark, sf))
    return out.select("document_id", F.col("action_id.l_partkey").alias("part"), F.col("action_id.l_suppkey").alias("supp"), "action", "reason")


def _corrections(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("field"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.concat(F.lit("u"), (F.col("l_suppkey") % 5).cast("string")).alias("actor"), F.col("l_shipdate").alias("ts"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("correction_id"))


def merge_corrections(spark, sf):
    return W.merge_corrections(_corrections(spark, sf))


def _versions(spark, sf):
    return _t(spark, sf, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 17).cast("string")).alias("plugin_id"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), F.when(F.col("p_size") % 2 == 0, "draft").otherwise("published").alias("status"))


def plugin_versions(spark, sf):
    return W.plugin_versions(_versions(spark, sf))


def publish_versions(spark, sf):
    rows = _versions(spark, sf).distinct()
    return W.publish_versions(rows.where("plugin_id <> 'p3' or status <> 'draft'"))


def corrected_documents(spark, sf):
    return W.corrected_documents(_docs(spark, sf), _corrections(spark, sf).where("document_id % 3 > 0"))


def reviewed_reports(spark, sf):
    reports = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("report_id"), F.lit("completed").alias("status"), (F.col("o_orderkey") % 101).cast("int").alias("overall_score"))
    return C.reviewed_reports(reports, _overrides(spark, sf))


def document_cost(spark, sf):
    q = F.col("l_quantity").cast("int")
    u = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(*(F.sum(q * k).cast("double").alias(n) for n, k in (("router_in", 100), ("router_out", 10), ("normalizer_in", 300), ("normalizer_out", 50), ("outline_in", 200), ("outline_out", 20), ("compliance_in", 500), ("compliance_out", 70))), F.count("*").alias("pages"), (F.max("l_linenumber") > 5).alias("is_credit"), F.lit(1024).alias("memory_mb"), F.lit(30000).alias("duration_ms"))
    return W.document_cost(u)


def processing_time(spark, sf):
    daily = F.concat_ws("/", F.col("document_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return W.processing_time(_events(spark, sf).withColumn("document_id", daily))


def cost_rollup(spark, sf):
    return W.cost_rollup(_docs(spark, sf).select("document_type", F.date_format("created_at", "yyyy-MM").alias("month"), "cost"))


def budget_flags(spark, sf):
    b = spark.createDataFrame([("type_0", 100000.0, 50000.0), ("type_1", 20000.0, 10000.0)], "document_type string, max_cost double, warn_cost double")
    return W.budget_flags(_docs(spark, sf), b)


def deferred_ready(spark, sf):
    return W.deferred_ready(_docs(spark, sf).withColumn("original_key", F.when(F.col("document_id") % 5 > 0, F.col("file_name"))))


def route_mode(spark, sf):
    d = _docs(spark, sf).select("document_id", F.when(F.col("version") == 0, "both").when(F.col("version") == 1, "understand").when(F.col("version") == 2, "other").alias("mode"), (F.col("document_id") % 2 == 0).alias("has_plan"), (F.col("document_id") % 3).alias("n_baselines"))
    return W.route_mode(d)


def retention(spark, sf):
    return W.retention(_docs(spark, sf), "created_at", F.to_timestamp(F.lit("1998-12-31")), 365).select("document_id", "tier")


QUERIES = {
    f.__name__: f
    for f in (
        compliance_baselines, requirement_batches, candidate_pages, evaluate_requirements, report_scores, scores_with_missing, document_score, apply_reviews, feedback_from_reviews, recent_corrections, verdict_cube, extract_requirements, append_requirements, edit_requirements, baseline_lifecycle,
        list_documents, status_metrics, review_queue, work_queue, merge_pending, stage_status, stage_elapsed, latest_event, parse_progress, section_progress, apply_review_actions, rejected_actions, merge_corrections, corrected_documents, plugin_versions, publish_versions, reviewed_reports, document_cost, processing_time, cost_rollup, budget_flags, deferred_ready, route_mode, retention,
    )
}

SCORES = f"{VERDICTS}, sc AS (SELECT doc_id, baseline_id, CASE WHEN count(*) FILTER (verdict <> 'NOT_APPLICABLE') = 0 THEN 0 ELSE round_even(100.0 * count(*) FILTER (verdict = 'PASS') / count(*) FILTER (verdict <> 'NOT_APPLICABLE'), 0) END::INT AS overall_score FROM vd GROUP BY 1, 2)"
REVIEWED = f"""{VERDICTS}, v AS (SELECT doc_id AS report_id, requirement_id, verdict FROM vd QUALIFY row_number() OVER (PARTITION BY doc_id, requirement_id ORDER BY seq DESC, supp DESC, l_extendedprice DESC) = 1),
  o AS (SELECT doc_id AS report_id, CASE WHEN seq % 2 = 0 THEN requirement_id ELSE requirement_id || 'x' END AS rid, CASE WHEN supp % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS cv, 'note ' || supp AS note, seq, supp, l_extendedprice FROM vd WHERE seq % 5 = 1),
  lo AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY report_id, rid ORDER BY seq DESC, supp DESC, l_extendedprice DESC) = 1),
  rv AS (SELECT coalesce(v.report_id, lo.report_id) AS report_id, coalesce(v.requirement_id, rid) AS requirement_id, verdict, cv AS reviewer_override, note AS reviewer_note, coalesce(cv, verdict) AS effective_verdict FROM v FULL JOIN lo ON v.report_id = lo.report_id AND v.requirement_id = lo.rid)"""
FLAGS = ", ".join(f"max((stage = '{s}')::INT) AS {s}" for s in W.STAGES)

ACTIONS = """a AS (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS document_id, CASE WHEN l_quantity < 14 THEN 'approve' WHEN l_quantity < 27 THEN 'reject' WHEN l_quantity < 39 THEN 'correct' WHEN l_quantity < 45 THEN 'reprocess' ELSE 'archive' END AS action, l_linenumber - 1 AS v, l_tax > 0.02 AS noted, l_partkey AS part, l_suppkey AS supp,
    row_number() OVER (PARTITION BY CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
  r(document_id, i, status, review_status, version, reason) AS (SELECT document_id, 0::BIGINT, status, review_status, version, NULL::VARCHAR FROM docs UNION ALL
    SELECT document_id, i, CASE WHEN action = 'reprocess' THEN 'REPROCESSING' ELSE status END, CASE WHEN why IS NOT NULL THEN review_status WHEN action = 'approve' THEN 'APPROVED' WHEN action = 'reject' THEN 'REJECTED' ELSE 'PENDING_REVIEW' END, version + (why IS NULL AND action <> 'reprocess')::INT, why FROM (
      SELECT r.document_id, a.i, r.status, r.review_status, r.version, a.action, CASE WHEN action = 'reprocess' THEN NULL WHEN action = 'archive' THEN 'unknown action' WHEN action = 'reject' AND NOT noted THEN 'notes missing' WHEN v <> r.version THEN 'stale version' END AS why FROM r JOIN a ON a.document_id = r.document_id AND a.i = r.i + 1))"""

SQL = {
    "compliance_baselines": """WITH d AS (SELECT c_custkey AS doc_id, 'p' || c_custkey % 1000 AS plugin_id FROM customer), b AS (SELECT s_suppkey::VARCHAR AS baseline_id, ['p' || s_suppkey, 'p' || (s_suppkey + 1)] AS plugin_ids FROM supplier WHERE s_suppkey % 3 <> 2)
      SELECT DISTINCT doc_id, baseline_id FROM d JOIN b ON CASE WHEN doc_id % 3 = 0 THEN baseline_id IN ((doc_id % 7)::VARCHAR, '1') ELSE list_contains(plugin_ids, plugin_id) END""",
    "requirement_batches": "SELECT l_suppkey::VARCHAR AS baseline_id, l_partkey AS requirement_id, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1) // 10)::INT AS batch FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    "candidate_pages": f"WITH {REQS}, {PAGES}, {WORDS} SELECT requirement_id, doc_id, page_number, count(DISTINCT term)::INT AS found FROM wd JOIN req USING (term) GROUP BY 1, 2, 3",
    "evaluate_requirements": f"""WITH {REQS}, {PAGES}, {WORDS}, h AS (SELECT requirement_id, doc_id, count(DISTINCT term) AS f, array_to_string(min_by(w[greatest(1, i - 8):i + n + 7], (page_number, i, term)), ' ') AS evidence, min(page_number) AS first_page, list_aggregate(list_sort(list(DISTINCT page_number)), 'string_agg', ',') AS page_references FROM wd JOIN req USING (term) GROUP BY 1, 2)
      SELECT d.doc_id, rq.requirement_id, CASE WHEN coalesce(f, 0) = 0 THEN 'NOT_FOUND' WHEN f = len(terms) THEN 'PASS' ELSE 'PARTIAL' END AS verdict, CASE WHEN f > 0 THEN round(f / len(terms)::DOUBLE, 6) ELSE 0 END AS confidence, coalesce(evidence, '') AS evidence, first_page, coalesce(page_references, '') AS page_references
      FROM documents d JOIN rq ON baseline_id = 'b' || d.doc_id % 4 LEFT JOIN h ON h.doc_id = d.doc_id AND h.requirement_id = rq.requirement_id""",
    "report_scores": f"WITH {SCORES} SELECT * FROM sc",
    "scores_with_missing": f"WITH {SCORES} SELECT o_orderkey AS doc_id, coalesce(baseline_id, 'no_baselines') AS baseline_id, coalesce(overall_score, -1) AS overall_score FROM orders LEFT JOIN sc ON sc.doc_id = o_orderkey",
    "document_score": f"WITH {SCORES} SELECT doc_id, max_by(overall_score, baseline_id) AS compliance_score FROM sc JOIN orders ON o_orderkey = doc_id GROUP BY 1",
    "apply_reviews": f"WITH {REVIEWED} SELECT * FROM rv",
    "feedback_from_reviews": f"WITH {REVIEWED} SELECT requirement_id, verdict AS original_verdict, reviewer_override AS corrected_verdict, count(*) AS n FROM rv WHERE reviewer_override IS NOT NULL GROUP BY 1, 2, 3",
    "recent_corrections": f"""WITH {EVENTS}, f AS (SELECT event_id, 'r' || floor(value)::INT % 20 AS rid, CASE WHEN floor(value)::INT % 2 = 0 THEN 'PASS' ELSE 'PARTIAL' END AS cv, ts, (floor(value)::INT % 20) // 10 AS batch FROM ev WHERE event_type = 'error'),
      a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY ts DESC, event_id DESC) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY batch ORDER BY ts DESC, event_id DESC) <= 5)
      SELECT batch::INT AS batch, string_agg(rid || ' FAIL -> ' || cv, chr(10) ORDER BY ts DESC, event_id DESC) AS lines FROM b GROUP BY 1""",
    "verdict_cube": f"""WITH {VERDICTS} SELECT baseline_id, category, criticality, count(*) AS verdicts, count(*) FILTER (verdict = 'PASS') AS passed, grouping(baseline_id, category, criticality)::INT AS level,
      CASE WHEN count(*) FILTER (verdict <> 'NOT_APPLICABLE') > 0 THEN round(count(*) FILTER (verdict = 'PASS') / (count(*) FILTER (verdict <> 'NOT_APPLICABLE'))::DOUBLE, 6) END AS pass_rate FROM vd GROUP BY CUBE (baseline_id, category, criticality)""",
    "extract_requirements": r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+|[.!?\n]+')) AS p, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+|[.!?\n]+'), 1) AS i FROM documents),
      e AS (SELECT doc_id, p, length(p) AS n, regexp_matches(p, '^[.!?\n]') AS stop, sum(length(p)) OVER w - length(p) AS o, sum(regexp_matches(p, '^[.!?\n]')::INT) OVER w AS k FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      f AS (SELECT doc_id, k::INT AS seq, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS t, (o // 1500 + 1)::INT AS first_page, ((o + n - 1) // 1500 + 1)::INT AS last_page FROM e WHERE NOT stop AND regexp_matches(lower(p), '(^|[^\p{L}])(that|not|für|sur)([^\p{L}]|$)'))
      SELECT doc_id, seq, md5(t) AS text_md5, 'General' AS category, 'should-have' AS criticality, first_page, last_page, CASE WHEN first_page >= 2 THEN 'part ' || (first_page - (first_page - 2) % 3) END AS source_section FROM f""",
    "append_requirements": f"""WITH {VERDICTS}, n AS (SELECT supp, category, requirement_id || '-' || seq AS t, 'src' || doc_id % 3 AS src FROM vd),
      a AS (SELECT supp, string_agg(t, ',' ORDER BY t, category) AS t, string_agg(DISTINCT src, ',' ORDER BY src) AS src FROM n GROUP BY 1), c AS (SELECT s_suppkey AS supp, 'General' AS category FROM supplier UNION SELECT s_suppkey, 'c1' FROM supplier UNION SELECT supp, category FROM n)
      SELECT s_suppkey AS baseline_id, (SELECT string_agg(category, ',' ORDER BY category) FROM c WHERE c.supp = s_suppkey) AS categories, concat_ws(',', s_name, t) AS requirements, coalesce(src, '') AS sources FROM supplier LEFT JOIN a ON a.supp = s_suppkey""",
    "edit_requirements": """WITH b AS (SELECT p_partkey % 10 AS baseline_id, p_partkey AS requirement_id, p_name AS text, 'General' AS category FROM part),
      o AS (SELECT l_partkey % 10 AS baseline_id, CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END AS requirement_id, CASE WHEN l_quantity < 17 THEN 'delete' WHEN l_quantity < 34 THEN 'update' ELSE 'add' END AS op, CASE WHEN l_linenumber % 3 > 0 THEN 't' || l_linenumber END AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'Credit' END AS c FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
      SELECT coalesce(b.baseline_id, o.baseline_id) AS baseline_id, coalesce(b.requirement_id, o.requirement_id) AS requirement_id, CASE WHEN op IN ('update', 'add') THEN coalesce(t, text) ELSE text END AS text, CASE WHEN op IN ('update', 'add') THEN coalesce(c, category) ELSE category END AS category, coalesce(text IS NULL AND op <> 'add', false) AS rejected
      FROM b FULL JOIN o ON b.requirement_id = o.requirement_id WHERE coalesce(op, 'keep') <> 'delete' OR text IS NULL""",
    "baseline_lifecycle": """WITH o AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'publish' ELSE 'archive' END AS op FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)
      SELECT s_suppkey AS baseline_id, CASE WHEN op = 'publish' AND s_suppkey % 3 > 0 THEN 'published' WHEN op = 'archive' THEN 'archived' ELSE 'draft' END AS status, CASE WHEN op = 'publish' AND s_suppkey % 3 > 0 THEN 1 ELSE 0 END AS version FROM supplier LEFT JOIN o ON l_suppkey = s_suppkey""",
    "list_documents": f"WITH {DOCS} SELECT document_id, status FROM docs WHERE status = 'PENDING' AND document_id > 50 ORDER BY document_id LIMIT 100",
    "status_metrics": f"WITH {DOCS} SELECT 'status' AS kind, status AS name, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'review', review_status, count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM docs",
    "review_queue": f"WITH {DOCS} SELECT document_id, created_at FROM docs WHERE review_status = 'PENDING_REVIEW' ORDER BY created_at DESC, document_id LIMIT 100",
    "work_queue": f"""WITH {DOCS}, b AS (SELECT *, CASE WHEN status = 'FAILED' THEN 0 WHEN status = 'PENDING' THEN 1 WHEN review_status = 'PENDING_REVIEW' THEN 2 ELSE 3 END AS bucket FROM docs WHERE contains(document_id || ' ' || file_name, 'file-1') AND document_type = 'type_1')
      SELECT document_id, bucket, CASE WHEN sort = 'attention' THEN bucket ELSE 0 END AS sort_group, CASE WHEN sort = 'cost' THEN -round(cost * 100)::BIGINT WHEN sort = 'oldest' OR (sort = 'attention' AND bucket IN (1, 2)) THEN epoch(created_at)::BIGINT ELSE -epoch(created_at)::BIGINT END AS sort_key, sort FROM b, (VALUES ('attention'), ('newest'), ('oldest'), ('cost')) v(sort)""",
    "corrected_documents": f"""WITH {DOCS}, c AS (SELECT l_orderkey AS document_id, count(DISTINCT l_linenumber % 3) AS n, arg_max('u' || l_suppkey % 5, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity)) AS who, max(l_shipdate) AS at_ FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1)
      SELECT document_id, CASE WHEN n > 0 THEN 'PENDING_REVIEW' ELSE review_status END AS review_status, coalesce(n, 0) AS corrections, who AS last_corrected_by, at_ AS last_corrected_at FROM docs LEFT JOIN c USING (document_id)""",
    "publish_versions": """WITH v AS (SELECT DISTINCT 'p' || p_partkey % 17 AS plugin_id, p_size AS n, p_size % 2 = 0 AS draft FROM part WHERE p_partkey % 17 <> 3 OR p_size % 2 = 1), m AS (SELECT plugin_id, max(n) FILTER (draft) AS d FROM v GROUP BY 1)
      SELECT plugin_id, 'v' || n AS version, CASE WHEN n = d THEN 'published' WHEN NOT draft AND d IS NOT NULL THEN 'archived' WHEN draft THEN 'draft' ELSE 'published' END AS status FROM v JOIN m USING (plugin_id)""",
    "reviewed_reports": f"WITH {REVIEWED} SELECT o_orderkey AS report_id, CASE WHEN o_orderkey IN (SELECT report_id FROM o) THEN 'reviewed' ELSE 'completed' END AS status, (o_orderkey % 101)::INT AS overall_score FROM orders",
    "merge_pending": f"WITH {DOCS} SELECT document_id, 0 AS place FROM docs WHERE document_id % 6 = 0 UNION ALL SELECT document_id, 1 FROM docs WHERE document_id % 3 <> 0",
    "stage_status": f"""WITH {EVENTS}, f AS (SELECT document_id, {FLAGS}, max(contains(message, 'failed')::INT) AS failed FROM ev GROUP BY 1),
      r AS (SELECT document_id, 'router' AS stage, router AS s, greatest(extractor, normalizer, compliance) AS later, failed FROM f UNION ALL SELECT document_id, 'extractor', extractor, greatest(normalizer, compliance), failed FROM f
        UNION ALL SELECT document_id, 'normalizer', normalizer, compliance, failed FROM f UNION ALL SELECT document_id, 'compliance', compliance, 0, failed FROM f)
      SELECT document_id, stage, CASE WHEN s = 1 AND later = 1 THEN 'COMPLETED' WHEN s = 1 AND failed = 1 THEN 'FAILED' WHEN s = 1 THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM r""",
    "stage_elapsed": f"WITH {EVENTS} SELECT document_id, stage, CASE WHEN count(*) >= 2 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) END AS elapsed FROM ev GROUP BY 1, 2",
    "latest_event": f"WITH {EVENTS} SELECT document_id, event_id, stage, message FROM ev QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1",
    "parse_progress": f"""WITH {EVENTS}, k AS (SELECT document_id, message FROM ev WHERE message LIKE 'Classified%' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1),
      t AS (SELECT document_id, message FROM ev WHERE message LIKE 'Targeted%' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT d.document_id, split_part(k.message, ' ', 3) AS document_type, split_part(split_part(k.message, 'confidence: ', 2), ')', 1) AS confidence, split_part(split_part(t.message, ' ', 2), '/', 1)::INT AS targeted, split_part(split_part(t.message, ' ', 2), '/', 2)::INT AS total, split_part(t.message, ' ', 5)::INT AS sections
      FROM (SELECT DISTINCT document_id FROM ev) d LEFT JOIN k USING (document_id) LEFT JOIN t USING (document_id)""",
    "section_progress": f"""WITH {EVENTS}, e AS (SELECT document_id, 's' || floor(value)::BIGINT % 30 AS sid, event_type AS t, ts, event_id FROM ev),
      g AS (SELECT document_id, sid, max((t IN ('view', 'click'))::INT) AS s, max((t = 'purchase')::INT) AS f, max((t = 'error')::INT) AS x, max(CASE WHEN t IN ('view', 'click') THEN ts END) AS at_ FROM e GROUP BY 1, 2)
      SELECT document_id, sum(s)::BIGINT AS started, sum(f)::BIGINT AS finished, sum(x)::BIGINT AS failed, max_by(CASE WHEN s = 1 AND f = 0 AND x = 0 THEN sid END, CASE WHEN s = 1 AND f = 0 AND x = 0 THEN at_ END) AS current_section FROM g GROUP BY 1""",
    "apply_review_actions": f"WITH RECURSIVE {DOCS}, {ACTIONS} SELECT document_id, status, review_status, version FROM r QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1",
    "rejected_actions": f"WITH RECURSIVE {DOCS}, {ACTIONS} SELECT document_id, part, supp, action, reason FROM r JOIN a USING (document_id, i) WHERE reason IS NOT NULL UNION ALL SELECT document_id, part, supp, action, 'unknown document' FROM a WHERE document_id NOT IN (SELECT document_id FROM docs)",
    "merge_corrections": """SELECT l_orderkey AS document_id, 'f' || l_linenumber % 3 AS field, l_quantity::INT::VARCHAR AS value, 'u' || l_suppkey % 5 AS actor FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1""",
    "plugin_versions": "SELECT 'p' || p_partkey % 17 AS plugin_id, 'v' || max(p_size) AS newest, 'v' || max(p_size) + 1 AS next_version, 'v' || max(p_size) FILTER (p_size % 2 = 0) AS publishable FROM part GROUP BY 1",
    "document_cost": """WITH u AS (SELECT l_orderkey AS document_id, sum(l_quantity::INT)::DOUBLE AS q, count(*) AS pages, max(l_linenumber) > 5 AS cr FROM lineitem GROUP BY 1),
      c AS (SELECT document_id, q * 0.1::DOUBLE * 0.001::DOUBLE + q * 0.01::DOUBLE * 0.005::DOUBLE AS router, q * 0.3::DOUBLE * 0.001::DOUBLE + q * 0.05::DOUBLE * 0.005::DOUBLE AS normalizer, q * 0.2::DOUBLE * 0.001::DOUBLE + q * 0.02::DOUBLE * 0.005::DOUBLE AS outline,
        q * 0.5::DOUBLE * (0.3::DOUBLE * 0.001::DOUBLE + 0.7::DOUBLE * 0.003::DOUBLE) + q * 0.07::DOUBLE * (0.3::DOUBLE * 0.005::DOUBLE + 0.7::DOUBLE * 0.015::DOUBLE) AS compliance, pages * 0.02::DOUBLE AS pages_, CASE WHEN cr THEN 15 ELSE 10 END * 0.000025::DOUBLE AS trans, (6 + pages) * 0.0000002::DOUBLE + 30 * 0.0000166667::DOUBLE AS compute FROM u)
      SELECT document_id, round(router, 6) AS router_cost, round(normalizer, 6) AS normalizer_cost, round(outline, 6) AS outline_cost, round(compliance, 6) AS compliance_cost, round(pages_, 6) AS pages_cost, round(trans, 6) AS transitions_cost, round(compute, 6) AS compute_cost,
        round(router + normalizer + outline + compliance + pages_ + trans + compute, 4) AS total_cost FROM c""",
    "processing_time": f"""WITH {EVENTS}, s AS (SELECT document_id || '/' || strftime(ts, '%Y-%m-%d') AS document_id, greatest(0.0::DOUBLE, least(3600.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)) AS s FROM ev GROUP BY 1)
      SELECT document_id, round(s, 3) AS seconds, round(s * 0.3::DOUBLE, 3) AS router_seconds, round(s * 0.25::DOUBLE, 3) AS extractor_seconds, round(s * 0.15::DOUBLE, 3) AS normalizer_seconds, round(s * 0.3::DOUBLE, 3) AS compliance_seconds FROM s""",
    "cost_rollup": f"WITH {DOCS} SELECT document_type, strftime(created_at, '%Y-%m') AS month, grouping(document_type, strftime(created_at, '%Y-%m'))::INT AS level, count(*) AS documents, round(sum(cost), 2) AS cost, round(sum(cost) / count(*), 4) AS cost_per_document FROM docs GROUP BY ROLLUP (document_type, strftime(created_at, '%Y-%m'))",
    "budget_flags": f"WITH {DOCS} SELECT document_id, CASE WHEN cost > CASE document_type WHEN 'type_0' THEN 100000 WHEN 'type_1' THEN 20000 END THEN 'over' WHEN cost > CASE document_type WHEN 'type_0' THEN 50000 WHEN 'type_1' THEN 10000 END THEN 'warn' ELSE 'ok' END AS flag FROM docs",
    "deferred_ready": f"WITH {DOCS} SELECT document_id, CASE WHEN status <> 'PROCESSED' THEN 'wrong status' WHEN document_id % 5 = 0 THEN 'no stored file' ELSE 'ready' END AS reason FROM docs",
    "route_mode": f"""WITH {DOCS}, m AS (SELECT document_id, CASE version WHEN 0 THEN 'both' WHEN 1 THEN 'understand' ELSE 'extract' END AS mode FROM docs)
      SELECT document_id, mode, CASE WHEN mode = 'understand' THEN 'tree' WHEN document_id % 2 = 0 THEN 'plugin' ELSE 'legacy' END AS extract_path, CASE WHEN document_id % 3 > 0 THEN 'evaluate' ELSE 'skip' END AS compliance_path FROM m""",
    "retention": f"WITH {DOCS}, a AS (SELECT document_id, date_diff('day', created_at::DATE, DATE '1998-12-31') AS age FROM docs) SELECT document_id, CASE WHEN age >= 90 THEN 'cold' WHEN age >= 30 THEN 'cool' ELSE 'hot' END AS tier FROM a WHERE age < 365",
}
