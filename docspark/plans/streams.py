"""Queries of the streams: what is there is read as a stream, the result is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.operators.shared import broadcast_if_small, shared_folder
from docspark.plans import config, sources, workflow
from docspark.plans import pages as P
from docspark.streaming import events as S


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf):
    """The events as a stream of arriving files, with documents, stages and messages as in the batch queries."""
    events, arrived = spark.read.parquet(f"{sf}/events.parquet"), f"{_folder(spark)}/arrived"
    events.write.parquet(arrived)
    return workflow.events_of(spark.readStream.schema(events.schema).parquet(arrived))


def stream_document_state(spark, sf):
    at = _folder(spark)
    S.run_available(S.stream_document_state(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint", "complete")
    return spark.read.parquet(f"{at}/out")


def stream_windowed_counts(spark, sf):
    at = _folder(spark)
    S.run_available(S.windowed_counts(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("start timestamp, stage string, events bigint").parquet(f"{at}/out/*")


def stream_dedup(spark, sf):
    """Files of equal content once: the landed files, and each of them a second time."""
    at, landed = _folder(spark), sources.landed(spark, sf)
    files = S.stream_ingest(spark, landed)
    files = files.unionByName(files.withColumn("document_id", F.concat("document_id", F.lit("-copy")))).where("file_name <> '_SUCCESS'")
    S.run_available(S.stream_dedup(files).select("content_hash", "file_size"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("content_hash string, file_size bigint").parquet(f"{at}/out/*")


def stream_pipeline(spark, sf):
    """The landed files through the whole pipeline, in pages of 400 characters."""
    at, landed = _folder(spark), sources.landed(spark, sf)
    S.stream_pipeline(spark, landed, f"{at}/out", f"{at}/checkpoint", config.sections(spark), config.rules(spark), 400).awaitTermination()
    plans = spark.read.schema("doc_id string, section_id string, section_pages array<int>").parquet(f"{at}/out/plans/*")
    return plans.select(F.regexp_extract("doc_id", "=(.*)$", 1).alias("source"), "section_id", F.array_join(F.transform("section_pages", lambda p: p.cast("string")), ",").alias("section_pages"))


def stream_enrich_config(spark, sf):
    """Events with the name of the nation that their document falls to, read as a table of configuration."""
    at = _folder(spark)
    named = lambda batch, config: batch.join(broadcast_if_small(config), F.col("document_id") % 25 == F.col("n_nationkey")).select("event_id", "document_id", "stage", F.col("n_name").alias("plugin"))
    S.each_batch_with_config(_stream(spark, sf), f"{sf}/nation.parquet", named, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, document_id bigint, stage string, plugin string").parquet(f"{at}/out/*")


def stream_section_progress(spark, sf):
    """The state of each document after all its events."""
    at = _folder(spark)
    S.run_progress(workflow.section_events(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint")
    return S.latest_progress(spark.read.schema(f"{S.PROGRESS}, batch int").parquet(f"{at}/out"))


QUERIES = {f.__name__: f for f in (stream_document_state, stream_windowed_counts, stream_dedup, stream_pipeline, stream_enrich_config, stream_section_progress)}

LANDED = sources.LANDED

SQL = {
    "stream_enrich_config": f"WITH {workflow.EVENTS} SELECT event_id, document_id, stage, n_name AS plugin FROM ev JOIN nation ON n_nationkey = document_id % 25",
    "stream_section_progress": workflow.SQL["section_progress"],
    "stream_document_state": f"WITH {workflow.EVENTS} SELECT document_id, stage, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, max(contains(message, 'failed')::INT) AS failed FROM ev GROUP BY 1, 2",
    "stream_windowed_counts": f"WITH {workflow.EVENTS}, w AS (SELECT date_trunc('hour', ts) AS start, stage, count(*) AS events FROM ev GROUP BY 1, 2) SELECT start, stage, events FROM w WHERE start + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ev)",
    "stream_dedup": f"WITH {LANDED} SELECT DISTINCT sha256(text) AS content_hash, octet_length(encode(text)) AS file_size FROM landed",
    "stream_pipeline": f"WITH {LANDED}, {P.PLAN.replace(P.DOCS, 'docs AS (SELECT * FROM landed)')} SELECT doc_id AS source, section_id, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS section_pages FROM filled GROUP BY 1, 2",
}
