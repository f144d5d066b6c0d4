"""Report sections and case summaries, computed for all captures and cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import labels
from postern.functions.columns import literal_table
from postern.operators.digests import tree_text

EVIDENCE_LEAF = 4_096


def executive_summary(sessions: DataFrame, findings: DataFrame, anomalies: DataFrame, captures: DataFrame) -> DataFrame:
    """Long form (capture, section, item, n) with severities and bands zero-filled."""
    spark = captures.sparkSession
    rows = [("severity", s) for s in V.SEVERITY_ORDER] + [("band", b) for b in V.ANOMALY_BAND_ORDER]
    rows += [("total", t) for t in ("sessions", "findings", "anomalies")]
    grid = captures.select("capture_id").crossJoin(F.broadcast(literal_table(spark, rows, ["section", "item"])))
    counted = lambda df, section, item: df.groupBy("capture_id", item.alias("item")).agg(F.count("*").alias("n")).select(
        "capture_id", F.lit(section).alias("section"), "item", "n"
    )
    counts = (
        counted(findings, "severity", F.col("severity"))
        .unionByName(counted(anomalies, "band", F.coalesce("band", "status")))
        .unionByName(counted(sessions, "total", F.lit("sessions")))
        .unionByName(counted(findings, "total", F.lit("findings")))
        .unionByName(counted(anomalies, "total", F.lit("anomalies")))
    )
    filled = grid.join(counts, ["capture_id", "section", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.unionByName(counted(sessions, "protocol", F.coalesce("protocol", F.lit("unknown"))))


def tls_coverage(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("capture_id").agg(
        F.count("*").alias("sessions_total"),
        F.count_if(F.col("handshake").isNotNull()).alias("sessions_with_tls_handshake"),
        F.count_if(F.col("starttls").isNotNull()).alias("sessions_with_starttls"),
        F.count_if(F.coalesce(F.col("handshake.handshake_complete"), F.lit(False))).alias("handshakes_complete"),
    )


def tls_summary(sessions: DataFrame) -> DataFrame:
    """All handshake counters in one scan: the facets of a session are exploded, then counted."""
    hs = lambda n: F.col(f"handshake.{n}")
    complete = F.coalesce(hs("handshake_complete"), F.lit(False))
    facet = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("facet"), value.alias("item")))
    facets = F.array_compact(
        F.array(
            facet("version", hs("tls_version")),
            facet("cipher_family", F.split(hs("cipher_suite"), "_")[0]),
            facet("key_exchange", hs("key_exchange")),
            facet("handshake", F.when(complete, "complete").otherwise("incomplete")),
            facet("incomplete_reason", F.when(~complete, F.coalesce(F.nullif(hs("completeness_reason"), F.lit("")), F.lit("unspecified")))),
        )
    )
    rows = sessions.where(F.col("handshake").isNotNull()).select("capture_id", F.explode(facets).alias("f"))
    return rows.groupBy("capture_id", F.col("f.facet").alias("facet"), F.col("f.item").alias("item")).agg(F.count("*").alias("n"))


def certificate_inventory(sessions: DataFrame) -> DataFrame:
    """Distinct certificates of sessions with a handshake; the first seen (by time, session) represents each."""
    seen = sessions.where(F.col("handshake").isNotNull()).select(
        "capture_id", "session_id", "started_at", F.explode("certificates").alias("c")
    )
    return seen.groupBy("capture_id", F.col("c.fingerprint_sha256").alias("fingerprint_sha256")).agg(
        F.min_by("c", F.struct("started_at", "session_id", "c.position_in_chain")).alias("c"), F.count("*").alias("presentations")
    ).select(
        "capture_id", "fingerprint_sha256", "presentations", "c.subject", "c.issuer", "c.signature_algorithm",
        "c.public_key_algorithm", "c.public_key_size_bits", "c.position_in_chain",
    )


def top_per(df: DataFrame, key: str, order, limit: int) -> DataFrame:
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("position") <= limit)


def findings_section(findings: DataFrame, limit: int = V.MAX_REPORT_ROWS) -> DataFrame:
    order = [labels.severity_position("severity"), F.coalesce("session_id", F.lit("")), "rule_id", "finding_id"]
    return top_per(findings, "capture_id", order, limit)


def case_findings_section(findings: DataFrame, case_captures: DataFrame, limit: int = V.MAX_CASE_REPORT_ROWS) -> DataFrame:
    rows = findings.join(case_captures.select("case_id", "capture_id"), "capture_id")
    order = [labels.severity_position("severity"), "capture_id", "rule_id", "finding_id"]
    return top_per(rows, "case_id", order, limit)


def anomaly_section(anomalies: DataFrame, limit: int = V.MAX_REPORT_ROWS) -> DataFrame:
    """Band counts over all sessions of a capture, and how many of them are among its listed items."""
    listed = top_per(anomalies, "capture_id", ["protocol", "session_id"], limit)
    by_band = lambda df, name: df.groupBy("capture_id", F.coalesce("band", "status").alias("band")).agg(F.count("*").alias(name))
    counted = by_band(anomalies, "items").join(by_band(listed, "listed"), ["capture_id", "band"], "left")
    return counted.withColumn("listed", F.coalesce("listed", F.lit(0)))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by = lambda df, kind, column: df.groupBy("capture_id", F.col(column).alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    shared = (
        edges.where(F.col("edge_type") == "tls_contains_certificate").groupBy("capture_id", F.col("target_node_id").alias("item"))
        .agg(F.count("*").alias("n")).where(F.col("n") >= 2).withColumn("kind", F.lit("correlated_certificate"))
    )
    return by(nodes, "node_type", "node_type").unionByName(by(edges, "edge_type", "edge_type")).unionByName(shared)


def case_summary(case_captures, captures, analysis, sessions, findings, anomalies, posture) -> DataFrame:
    """Cards per attached capture; posture is quoted, never aggregated."""
    counted = lambda df, name: df.groupBy("capture_id").agg(F.count("*").alias(name))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        case_captures.select("case_id", "capture_id")
        .join(captures.select("capture_id", "filename"), "capture_id", "left")
        .join(analysis.select("capture_id", "status"), "capture_id", "left")
        .join(counted(sessions, "session_count"), "capture_id", "left")
        .join(counted(findings, "findings_count"), "capture_id", "left")
        .join(counted(anomalies, "anomalies_count"), "capture_id", "left")
        .join(posture.select("capture_id", "posture_state", "overall_score"), "capture_id", "left")
        .select(
            "case_id", "capture_id", F.col("filename").isNotNull().alias("available"), "filename",
            F.coalesce("status", F.lit("not_analyzed")).alias("analysis_status"), zero("session_count"), zero("findings_count"),
            zero("anomalies_count"), "posture_state", "overall_score",
        )
    )


def case_counts(case_captures, notes, bookmarks, timeline) -> DataFrame:
    """Analyst records per case."""
    counted = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("item", F.lit(name))
    return (
        counted(case_captures, "captures").unionByName(counted(notes, "notes"))
        .unionByName(counted(bookmarks, "bookmarks")).unionByName(counted(timeline, "timeline_events"))
    )


def remediation_counts(remediations: DataFrame) -> DataFrame:
    status, verification = F.col("status"), F.col("verification_status")
    buckets = {
        name: F.count_if(status.isin(*[s for s, b in V.REMEDIATION_STATUS_BUCKETS.items() if b == name]))
        for name in dict.fromkeys(V.REMEDIATION_STATUS_BUCKETS.values())
    }
    buckets |= {name: F.count_if(verification == s) for s, name in V.VERIFICATION_STATUS_BUCKETS.items()}
    return remediations.groupBy("case_id").agg(*[c.alias(n) for n, c in buckets.items()])


def evidence_manifest(case_captures, captures, analysis) -> DataFrame:
    return case_captures.select("case_id", "capture_id", "idx").join(
        captures.select("capture_id", "filename", "sha256", "size_bytes", "ingested_at"), "capture_id"
    ).join(analysis.select("capture_id", "status", "analyzed_at"), "capture_id", "left")


def evidence_digest(rows: DataFrame, leaf: int = EVIDENCE_LEAF) -> DataFrame:
    """Digest of (case_id, text) evidence rows: SHA-256 over the tree text of the rows' hashes, each with its number of copies."""
    hashed = rows.groupBy("case_id", F.sha2("text", 256).alias("h")).agg(F.concat_ws(":", "h", F.count("*").cast("string")).alias("item")).drop("h")
    sizes = hashed.groupBy("case_id").agg(F.count("*").alias("n"))
    return tree_text(hashed.join(sizes, "case_id"), ["case_id"], leaf).select("case_id", F.sha2("text", 256).alias("evidence_digest"))
