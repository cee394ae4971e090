"""Workflow of documents: events, stages, reviews, versions, queues, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Prices in dollars (1,000 tokens in and out; a page; a transition; an invocation; a GB second).
SMALL_MODEL, LARGE_MODEL, PAGE = (0.001, 0.005), (0.003, 0.015), 0.02
TRANSITION, INVOCATION, GB_SECOND = 0.000025, 0.0000002, 0.0000166667


def list_documents(docs: DataFrame, status: str, limit: int = 100, after: int | None = None) -> DataFrame:
    """One page of the documents of a status, by key; ``after`` continues behind a key."""
    rows = docs.where(F.col("status") == status)
    return (rows if after is None else rows.where(F.col("document_id") > after)).orderBy("document_id").limit(limit)


def status_metrics(docs: DataFrame) -> DataFrame:
    """(kind, name, n): documents by processing status, by review status and in all."""
    sets = docs.groupingSets([["status"], ["review_status"], []], "status", "review_status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "review").otherwise("total").alias("kind"), F.coalesce("status", "review_status", F.lit("all")).alias("name"), "n")


def review_queue(docs: DataFrame, status: str, limit: int = 100) -> DataFrame:
    return docs.where(F.col("review_status") == status).orderBy(F.desc("created_at"), "document_id").limit(limit)


def work_queue(docs: DataFrame, text: str = "", document_type: str | None = None, sort: str = "attention") -> DataFrame:
    """(document_id, bucket, sort_group, sort_key): documents with their attention bucket (failed, running, to
    review, rest), to be ordered by sort_group and sort_key.

    ``sort``: attention (by bucket, failed and rest newest first, the others oldest first), newest, oldest or cost
    (the dearest first; ``docs`` has cost).
    """
    rows = docs.where(F.contains(F.lower(F.concat_ws(" ", F.col("document_id").cast("string"), "file_name")), F.lit(text.lower())))
    if document_type is not None:
        rows = rows.where(F.col("document_type") == document_type)
    bucket = F.when(F.col("status") == "FAILED", 0).when(F.col("status") == "PENDING", 1).when(F.col("review_status") == "PENDING_REVIEW", 2).otherwise(3)
    age = F.unix_timestamp("created_at")
    keys = {"attention": F.when(bucket.isin(1, 2), age).otherwise(-age), "newest": -age, "oldest": age}
    key = -F.round(F.coalesce("cost", F.lit(0.0)) * 100).cast("bigint") if sort == "cost" else keys[sort]
    return rows.select("document_id", bucket.alias("bucket"), (bucket if sort == "attention" else F.lit(0)).alias("sort_group"), key.alias("sort_key"))


def merge_pending(server: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending rows that the server does not know yet, and the server's."""
    new = pending.join(server.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(0).alias("place"))
    return new.unionByName(server.select("document_id", F.lit(1).alias("place")))


#: The stages in their order.
STAGES = ["router", "extractor", "normalizer", "compliance"]


def stage_status(events: DataFrame) -> DataFrame:
    """(document_id, stage, status) for every stage of every document: completed, failed, begun or pending."""
    flags = [F.max((F.col("stage") == s).cast("int")).alias(s) for s in STAGES]
    one = events.groupBy("document_id").agg(*flags, F.max(F.contains("message", F.lit("failed")).cast("int")).alias("failed"))
    later = lambda k: F.greatest(F.lit(0), F.lit(0), *(F.col(s) for s in STAGES[k + 1 :]))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.when((F.col(s) == 1) & (later(k) == 1), "COMPLETED").when((F.col(s) == 1) & (F.col("failed") == 1), "FAILED").when(F.col(s) == 1, "IN_PROGRESS").otherwise("PENDING").alias("status")) for k, s in enumerate(STAGES)))
    return one.select("document_id", F.explode(rows).alias("r")).select("document_id", "r.stage", "r.status")


def stage_elapsed(events: DataFrame) -> DataFrame:
    """Seconds from a stage's first to its last event, to a tenth; null below two events."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return events.groupBy("document_id", "stage").agg(F.when(F.count("*") >= 2, F.round(span, 1)).alias("elapsed"))


def latest_event(events: DataFrame) -> DataFrame:
    return events.groupBy("document_id").agg(F.max_by(F.struct("event_id", "stage", "message"), F.struct("ts", "event_id")).alias("e")).select("document_id", "e.*")


def parse_progress(events: DataFrame) -> DataFrame:
    """What the last classification and targeting messages of a document say."""
    kind, target = r"Classified as (\S+) \(confidence: (\w+)\)", r"Targeted (\d+)/(\d+) pages across (\d+) sections"
    last = lambda p: F.max_by(F.when(F.col("message").rlike(p), F.col("message")), F.when(F.col("message").rlike(p), F.struct("ts", "event_id")))
    one = events.groupBy("document_id").agg(last(kind).alias("k"), last(target).alias("t"))
    pick = lambda c, p, n: F.nullif(F.regexp_extract(c, p, n), F.lit(""))
    return one.select("document_id", pick("k", kind, 1).alias("document_type"), pick("k", kind, 2).alias("confidence"), *(pick("t", target, n).cast("int").alias(a) for n, a in ((1, "targeted"), (2, "total"), (3, "sections"))))


def section_progress(events: DataFrame) -> DataFrame:
    """Counts of started, finished and failed sections, and the one started last that is still open.

    ``events`` has document_id, section_id, action (start, finish, fail) and ts, event_id.
    """
    one = events.groupBy("document_id", "section_id").agg(
        F.max((F.col("action") == "start").cast("int")).alias("s"), F.max((F.col("action") == "finish").cast("int")).alias("f"), F.max((F.col("action") == "fail").cast("int")).alias("x"), F.max(F.when(F.col("action") == "start", F.struct("ts", "event_id"))).alias("at")
    )
    is_open = (F.col("s") == 1) & (F.col("f") == 0) & (F.col("x") == 0)
    return one.groupBy("document_id").agg(F.sum("s").alias("started"), F.sum("f").alias("finished"), F.sum("x").alias("failed"), F.max_by(F.when(is_open, F.col("section_id")), F.when(is_open, F.col("at"))).alias("current_section"))


#: Actions that count for one version of a document only, and the review status that they set.
VERSIONED = {"approve": "APPROVED", "reject": "REJECTED", "correct": "PENDING_REVIEW"}


def fold_review_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(document_id, status, review_status, version, log): a document's actions applied one after another by ts,
    action_id. log: for each action its action_id, action and the reason why it was rejected, null if it counted.

    Approve, reject and correct count if their expected version is the current one, and raise it; a rejection
    needs notes. Reprocess always counts: it sets status REPROCESSING and review status PENDING_REVIEW and leaves
    the version. Without a column status in ``docs`` it is null at first. Other actions are rejected as unknown. The actions of one document are folded as one list:
    people make them, so it is short.
    """
    item = F.struct("ts", "action_id", "action", "expected_version", "notes")
    own = actions.groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("actions"))
    versioned = lambda x: F.coalesce(x.action.isin(*VERSIONED), F.lit(False))

    def reason(s: Column, x: Column) -> Column:
        silent = F.trim(F.coalesce(x.notes, F.lit(""))) == ""
        return (
            F.when(F.coalesce(x.action == "reprocess", F.lit(False)), None)
            .when(~versioned(x), "unknown action")
            .when((x.action == "reject") & silent, "notes missing")
            .when(~x.expected_version.eqNullSafe(s.version), "stale version")
        )

    def step(s: Column, x: Column) -> Column:
        why = reason(s, x)
        counts, again = why.isNull() & versioned(x), F.coalesce(x.action == "reprocess", F.lit(False))
        review = F.when(again, "PENDING_REVIEW")
        for action, status in VERSIONED.items():
            review = review.when(counts & (x.action == action), status)
        entry = F.struct(x.action_id.alias("action_id"), x.action.alias("action"), why.cast("string").alias("reason"))
        return F.struct((s.version + counts.cast("int")).cast("int").alias("version"), F.when(again, "REPROCESSING").otherwise(s.status).alias("status"), review.otherwise(s.review_status).alias("review_status"), F.concat(s.log, F.array(entry)).alias("log"))

    kind = actions.schema["action_id"].dataType.simpleString()
    start = F.struct(F.col("version").cast("int").alias("version"), (F.col("status") if "status" in docs.columns else F.lit(None)).cast("string").alias("status"), F.col("review_status").cast("string").alias("review_status"), F.array().cast(f"array<struct<action_id:{kind},action:string,reason:string>>").alias("log"))
    folded = docs.join(own, "document_id", "left").select("document_id", start.alias("start"), "actions")
    folded = folded.select("document_id", F.when(F.col("actions").isNull(), F.col("start")).otherwise(F.aggregate("actions", F.col("start"), step)).alias("s"))
    return folded.select("document_id", "s.status", "s.review_status", "s.version", "s.log")


def apply_review_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(document_id, status, review_status, version) after all actions; see ``fold_review_actions``."""
    return fold_review_actions(docs, actions).drop("log")


def rejected_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(document_id, action_id, action, reason) of the actions that changed nothing, those on unknown documents included."""
    log = fold_review_actions(docs, actions).select("document_id", F.explode("log").alias("x")).select("document_id", "x.*").where("reason is not null")
    lost = actions.join(docs.select("document_id"), "document_id", "left_anti").select("document_id", "action_id", "action", F.lit("unknown document").alias("reason"))
    return log.unionByName(lost)


def merge_corrections(corrections: DataFrame) -> DataFrame:
    """(document_id, field, value, actor): the last correction of each field."""
    last = corrections.groupBy("document_id", "field").agg(F.max_by(F.struct("value", "actor"), F.struct("ts", "correction_id")).alias("c"))
    return last.select("document_id", "field", "c.value", "c.actor")


def corrected_documents(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """(document_id, review_status, corrections, last_corrected_by, last_corrected_at): a document with corrections
    is to be reviewed again."""
    last = corrections.groupBy("document_id").agg(F.countDistinct("field").alias("n"), F.max_by(F.struct("actor", "ts"), F.struct("ts", "correction_id")).alias("c"))
    status = F.when(F.col("n") > 0, "PENDING_REVIEW").otherwise(F.col("review_status"))
    return docs.join(last, "document_id", "left").select("document_id", status.alias("review_status"), F.coalesce("n", F.lit(0)).alias("corrections"), F.col("c.actor").alias("last_corrected_by"), F.col("c.ts").alias("last_corrected_at"))


def publish_versions(versions: DataFrame) -> DataFrame:
    """(plugin_id, version, status) after each plugin's newest draft, in numeric order, is published: what was
    published before is archived, older drafts stay. Plugins without a draft keep all as it is."""
    n = F.substring("version", 2, 9).cast("int")
    newest = versions.where("status = 'draft'").groupBy("plugin_id").agg(F.max(n).alias("draft"))
    rows = versions.withColumn("n", n).join(newest, "plugin_id", "left")
    status = F.when((F.col("status") == "draft") & (F.col("n") == F.col("draft")), "published").when((F.col("status") == "published") & F.col("draft").isNotNull(), "archived").otherwise(F.col("status"))
    return rows.select("plugin_id", "version", status.alias("status"))


def plugin_versions(versions: DataFrame) -> DataFrame:
    """(plugin_id, newest, next_version, publishable) with versions like v10 in numeric order."""
    n = F.substring("version", 2, 9).cast("int")
    out = versions.groupBy("plugin_id").agg(F.max(n).alias("n"), F.max(F.when(F.col("status") == "draft", n)).alias("d"))
    return out.select("plugin_id", F.concat(F.lit("v"), F.col("n").cast("string")).alias("newest"), F.concat(F.lit("v"), (F.col("n") + 1).cast("string")).alias("next_version"), F.concat(F.lit("v"), F.col("d").cast("string")).alias("publishable"))


def _llm(tokens_in: Column, tokens_out: Column, price: tuple[float, float]) -> Column:
    return tokens_in / 1000 * price[0] + tokens_out / 1000 * price[1]


def document_cost(usage: DataFrame) -> DataFrame:
    """(document_id, costs, total): of tokens by step, pages, transitions and compute.

    ``usage`` has for each of router, normalizer, outline, compliance its _in and _out tokens, and pages, is_credit, memory_mb, duration_ms.
    """
    c = F.col
    compliance = _llm(c("compliance_in") * 0.3, c("compliance_out") * 0.3, SMALL_MODEL) + _llm(c("compliance_in") * 0.7, c("compliance_out") * 0.7, LARGE_MODEL)
    steps = {s: _llm(c(f"{s}_in"), c(f"{s}_out"), SMALL_MODEL) for s in ("router", "normalizer", "outline")} | {"compliance": compliance, "pages": c("pages") * PAGE}
    steps["transitions"] = F.when(c("is_credit"), 15).otherwise(10) * F.lit(TRANSITION)
    steps["compute"] = (6 + c("pages")) * F.lit(INVOCATION) + c("memory_mb") / 1024 * (c("duration_ms") / 1000) * F.lit(GB_SECOND)
    total = sum(list(steps.values())[1:], list(steps.values())[0])
    return usage.select("document_id", *(F.round(v, 6).alias(f"{k}_cost") for k, v in steps.items()), F.round(total, 4).alias("total_cost"))


def processing_time(events: DataFrame) -> DataFrame:
    """Seconds of a document's events, held to 0..3600, and the parts of the stages by fixed shares."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(3600.0), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6))
    out = events.groupBy("document_id").agg(s.alias("seconds"))
    return out.select("document_id", F.round("seconds", 3).alias("seconds"), *(F.round(F.col("seconds") * p, 3).alias(f"{n}_seconds") for n, p in (("router", 0.3), ("extractor", 0.25), ("normalizer", 0.15), ("compliance", 0.3))))


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Documents and cost by type and month, with subtotals."""
    out = costs.rollup("document_type", "month").agg(F.count("*").alias("documents"), F.sum("cost").alias("cost"), F.grouping_id().cast("int").alias("level"))
    return out.select("document_type", "month", "level", "documents", F.round("cost", 2).alias("cost"), F.round(F.col("cost") / F.col("documents"), 4).alias("cost_per_document"))


def budget_flags(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """ok, warn or over, by the budget of the document's type; no budget is ok. Budgets are configuration rows."""
    out = costs.join(budgets, "document_type", "left")
    return out.select("document_id", F.when(F.col("cost") > F.col("max_cost"), "over").when(F.col("cost") > F.col("warn_cost"), "warn").otherwise("ok").alias("flag"))


def deferred_ready(docs: DataFrame) -> DataFrame:
    reason = F.when(~F.col("status").isin("INDEXED", "COMPLETED", "PROCESSED"), "wrong status").when(F.col("original_key").isNull(), "no stored file").otherwise("ready")
    return docs.select("document_id", reason.alias("reason"))


def route_mode(docs: DataFrame) -> DataFrame:
    mode = F.when(F.col("mode").isin("understand", "extract", "both"), F.col("mode")).otherwise("extract")
    path = F.when(mode == "understand", "tree").when(F.col("has_plan"), "plugin").otherwise("legacy")
    return docs.select("document_id", mode.alias("mode"), path.alias("extract_path"), F.when(F.col("n_baselines") > 0, "evaluate").otherwise("skip").alias("compliance_path"))


def retention(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows that are not expired, with their storage tier."""
    age = F.datediff(now, F.col(ts))
    return rows.where(age < days).withColumn("tier", F.when(age >= 90, "cold").when(age >= 30, "cool").otherwise("hot"))
