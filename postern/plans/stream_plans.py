"""Queries: streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postern.functions.columns import iso_text
from postern.operators import reports as R
from postern.plans.findings_plans import flat
from postern.plans.base import query
from postern.session import shared_folder
from postern.sources import tables as T
from postern.streaming import jobs as J


def _stream_table(w, name):
    """A stream over a file of the test tables."""
    schema = w.table(name).schema
    return w.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(w.sf_dir)


def _stream_staged(w, table):
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    return w.spark.readStream.schema(table.schema).parquet(path)


def _finding_times(w):
    return _stream_staged(w, w.findings).select("severity", "detected_at")


@query("stream_rules")
def stream_rules(w):
    return flat(J.run_available(J.stream_rules(_stream_staged(w, w.sessions_with_auth)), "rules"))


@query("stream_flow_sessions")
def stream_flow_sessions(w):
    events = _stream_table(w, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.run_closable(events, lambda s: J.stream_flow_sessions(s, "user_id"), "ts", "flows")
    return out.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("closed_at").alias("closed_us"), "packets")


@query("stream_finding_counts")
def stream_finding_counts(w):
    out = J.run_closable(_finding_times(w), J.stream_finding_counts, "detected_at", "counts")
    return out.select(iso_text("window_start").alias("window_start"), "severity", "findings")


@query("stream_finding_counts_sliding")
def stream_finding_counts_sliding(w):
    out = J.run_closable(_finding_times(w), lambda s: J.stream_finding_counts(s, slide="15 minutes"), "detected_at", "sliding")
    return out.select(iso_text("window_start").alias("window_start"), "severity", "findings")


@query("stream_capture_dedup")
def stream_capture_dedup(w):
    d = _stream_table(w, "documents")
    uploads = d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("ingested_at"))
    return J.run_available(J.stream_capture_dedup(uploads), "dedup").select("sha256")


@query("sink_replace_capture")
def sink_replace_capture(w):
    """Write all findings, then replace every capture's by themselves: the stored table is unchanged."""
    path = f"{shared_folder(w.spark)}/replace-{uuid.uuid4().hex}"
    rows = w.findings.select("finding_id", "session_id", "rule_id", "severity", "capture_id")
    T.replace_captures(rows, path)
    T.replace_captures(rows, path, w.captures)
    return T.scan(w.spark, path)


@query("sink_json_document")
def sink_json_document(w):
    path = f"{shared_folder(w.spark)}/documents-{uuid.uuid4().hex}"
    rows = w.findings.select("finding_id", "rule_id", "severity", "observed_value", "expected_value")
    T.write_json_documents(rows, path)
    return w.spark.read.schema("finding_id string, rule_id string, severity string, observed_value string, expected_value string").json(path)


@query("report_document")
def report_document(w):
    """Report rows per capture as deterministic JSON text."""
    return T.json_documents(R.tls_coverage(w.sessions))
