"""Structured Streaming forms of the per-record operators.

Rules are stateless and run unchanged on a stream; flow sessions, counts and
deduplication keep bounded state behind a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.operators import rules
from postern.session import shared_folder
from postern.sources.policy import Policy

END_OF_TIME = 253_370_764_800  # 9999-01-01


def stream_rules(sessions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Findings of an append stream of sessions: the batch expressions, nothing kept. The authentication rule needs
    sessions that carry their ``auth_summary`` columns."""
    return rules.evaluate(sessions, None, policy)


def stream_flow_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions closed by a gap of silence; rows later than the watermark are dropped."""
    windows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return windows.agg(F.count("*").alias("packets")).select(
        key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "packets"
    )


def stream_finding_counts(findings: DataFrame, ts: str = "detected_at", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Findings per severity in tumbling or sliding windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return findings.withWatermark(ts, late).groupBy(window.alias("w"), "severity").agg(F.count("*").alias("findings")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "findings"
    )


def stream_capture_dedup(uploads: DataFrame, ts: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """First upload of every hash; the hash is remembered for the watermark delay."""
    return uploads.withWatermark(ts, late).dropDuplicatesWithinWatermark(["sha256"])


def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process everything available, append it to a table in the shared folder and read it back.

    ``base`` is the query's own folder, with its table and checkpoint: run again with
    it, also by another application after a failure, the query goes on where its
    checkpoint stands, and no row is read or written twice.
    """
    base = base or query_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/table")


def run_closable(source: DataFrame, job: Callable[[DataFrame], DataFrame], ts: str, name: str, base: str | None = None, close: bool = True) -> DataFrame:
    """Run ``job`` over all that ``source`` has; with ``close`` then emit its open windows and sessions.

    The job reads a second, so far empty, folder too. Closing puts one row there, NULL
    but for a time after all others, and runs the query again from its checkpoint:
    the row comes after every micro-batch of the source, however many there were, so
    none of them is late. Its own window stays open and is never emitted. A closed
    query takes no more rows.
    """
    spark = source.sparkSession
    base = base or query_folder(spark, name)
    closing = f"{base}/closing"
    spark.createDataFrame([], source.schema).write.mode("ignore").parquet(closing)
    stream = job(source.unionByName(spark.readStream.schema(source.schema).parquet(closing)))
    out = run_available(stream, name, base)
    if not close:
        return out
    last = F.timestamp_seconds(F.lit(END_OF_TIME))
    row = spark.range(1).select(*[(last if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema])
    row.write.mode("append").parquet(closing)
    return run_available(stream, name, base)


def query_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query in the shared one."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder}/stream-{name}-{uuid.uuid4().hex}"
