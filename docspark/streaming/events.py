"""Structured Streaming forms of ingestion, deduplication and document state.

The batch operators run on micro-batches or as streaming aggregates, so both give the same rows.
Late data: state that is kept by time takes a watermark as a parameter.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.operators.shared import materialize
from docspark.sources.landing import _named


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Each arriving file once, with its hash."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return _named(files).withColumn("content_hash", F.sha2("content", 256)).drop("content")


def stream_dedup(files: DataFrame, known: DataFrame | None = None, keep: str = "365 days") -> DataFrame:
    """The first file of each hash within the time that records are kept; hashes of ``known`` are left out."""
    fresh = files.withWatermark("modificationTime", keep).dropDuplicatesWithinWatermark(["content_hash"])
    return fresh if known is None else fresh.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def stream_document_state(events: DataFrame) -> DataFrame:
    """(document_id, stage, events, first_ts, last_ts, failed): a streaming aggregate for update mode."""
    return events.groupBy("document_id", "stage").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.contains("message", F.lit("failed")).cast("int")).alias("failed"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by stage and window of event time; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "stage", "events")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to ``out`` as Parquet. In complete mode each batch replaces the result; in append
    mode it has a folder of its own, so a batch that runs again replaces only what it wrote before."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_pipeline(spark: SparkSession, folder: str, out: str, checkpoint: str, sections: DataFrame, rules: DataFrame, chars: int = 1500, files_per_batch: int = 1000):
    """Files to pages to plans to records, micro-batch by micro-batch, with the batch operators.

    Each batch hashes its files, marks copies of files known or earlier in the batch as DUPLICATE, cuts the
    others' texts into pages, measures and selects them, and writes to ``out``: ``plans`` (doc_id, section_id,
    section_pages) and ``records`` (doc_id, file_name, content_hash, status, original_id, pages, targeted_pages).
    A batch writes to folders of its number, so one that runs again after a failure changes nothing. What
    batches share is the table of records, read anew by each.
    """
    from docspark.operators import dedup, pages, shared
    from docspark.operators import sections as S

    schema = "doc_id string, file_name string, content_hash string, status string, original_id string, pages bigint, targeted_pages bigint"
    spark.createDataFrame([], f"{schema}, batch int").write.mode("append").partitionBy("batch").parquet(f"{out}/records")

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(f"{schema}, batch int").parquet(f"{out}/records").where(F.col("batch") < number).select("content_hash", F.col("doc_id").alias("document_id"))
        files = shared.materialize(batch.select(F.col("document_id").alias("doc_id"), "file_name", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text")))
        status = dedup.dedup_against_history(files.select("doc_id", "content_hash"), known)
        new = files.join(status.where("status = 'STARTED'").select("doc_id"), "doc_id", "left_semi")
        scored = shared.materialize(S.page_scores(pages.page_quality(pages.paginate(new.select("doc_id", "text"), chars)), sections, rules))
        plan = shared.materialize(S.extraction_plan(S.select_pages(scored, sections), scored, sections))
        plan.write.mode("overwrite").parquet(f"{out}/plans/batch={number}")
        covered = S.plan_coverage(plan, scored).select("doc_id", F.col("total_pages").cast("bigint").alias("pages"), F.col("targeted_pages").cast("bigint").alias("targeted_pages"))
        records = files.drop("text").join(status.drop("content_hash"), "doc_id").join(covered, "doc_id", "left").select(*[c.split()[0] for c in schema.split(", ")])
        records.write.mode("overwrite").parquet(f"{out}/records/batch={number}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _named(files).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Refreshed:
    """A small table, read once and read again by the first use after ``max_age`` seconds. What was read is written
    down, so that all uses in between see the same rows, whatever happens to its files."""

    def __init__(self, path: str, max_age: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.path, self.max_age, self.clock = path, max_age, clock
        self.rows: DataFrame | None = None
        self.read_at = 0.0

    def get(self, session: SparkSession) -> DataFrame:
        now = self.clock()
        if self.rows is None or now - self.read_at > self.max_age:
            self.rows, self.read_at = materialize(session.read.parquet(self.path)), now
        return self.rows


def each_batch_with_config(stream: DataFrame, config: str | Refreshed, apply: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``apply(batch, configuration)`` on each micro-batch; the configuration is read again once it is older
    than 60 seconds. A batch writes to a folder of its number, so one that runs again after a failure replaces what
    it wrote before."""
    table = config if isinstance(config, Refreshed) else Refreshed(config)

    def run(batch: DataFrame, number: int) -> None:
        apply(batch, table.get(batch.sparkSession)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "document_id long, started long, finished long, failed long, current_section string"


class Sections(StatefulProcessor):
    """What is known of each section of a document: whether it was started, finished, failed, and its last start.

    Everything is kept by maxima, so the order in which events arrive does not matter. The state of a document
    goes by a timer, once the watermark is ``keep_ms`` past its last event.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sections = handle.getMapState("sections", "section_id string", "started int, finished int, failed int, at long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_ms = 0
        for batch in rows:
            last_ms = max(last_ms, int(batch["at"].max()) // 1000)
            for section, action, at, event in zip(batch["section_id"], batch["action"], batch["at"], batch["event_id"], strict=True):
                was = self.sections.getValue((section,)) if self.sections.containsKey((section,)) else (0, 0, 0, None, None)
                s, f, x = (int(n or a == action) for n, a in zip(was[:3], ("start", "finish", "fail"), strict=True))
                last = was[3:]
                if action == "start" and (last[0] is None or (at, event) > tuple(last)):
                    last = (int(at), int(event))
                self.sections.updateValue((section,), (s, f, x, *last))
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        ends = max([last_ms + self.keep_ms, *timers])
        for timer in timers:
            if timer != ends:
                self.handle.deleteTimer(timer)
        if ends not in timers:
            self.handle.registerTimer(ends)
        known = [(k[0], *v) for k, v in self.sections.iterator()]
        started = [k for k in known if k[1] and not k[2] and not k[3]]
        current = max(started, key=lambda k: k[4:])[0] if started else None
        yield pd.DataFrame({"document_id": [key[0]], "started": [sum(k[1] for k in known)], "finished": [sum(k[2] for k in known)], "failed": [sum(k[3] for k in known)], "current_section": [current]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sections.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_section_progress(events: DataFrame, keep_days: int = 365) -> DataFrame:
    """(document_id, started, finished, failed, current_section) as in ``section_progress``, of each document with
    new events: a stream for update mode. ``events`` has document_id, section_id, action, ts, event_id.

    The state lies in RocksDB, so it may outgrow memory; rows of a document meet by one shuffle a batch. Events
    more than ``keep_days`` behind the latest are left out, as their document's state may be gone.
    """
    rows = events.withWatermark("ts", f"{keep_days} days").select("ts", F.col("document_id").cast("long").alias("document_id"), "section_id", "action", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("document_id").transformWithStateInPandas(Sections(keep_days * 86_400_000), PROGRESS, "update", "eventTime")


def run_progress(events: DataFrame, out: str, checkpoint: str) -> None:
    """Runs ``stream_section_progress`` over what is there; each batch writes to a folder of its number."""
    conf = events.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        run_available(stream_section_progress(events), out, checkpoint, "update")
    finally:
        conf.set(STORE, before)


def latest_progress(batches: DataFrame) -> DataFrame:
    """The last row of each document, from the folders of ``run_progress``."""
    names = [c.split()[0] for c in PROGRESS.split(", ")[1:]]
    last = batches.groupBy("document_id").agg(F.max_by(F.struct(*names), "batch").alias("p"))
    return last.select("document_id", "p.*")
