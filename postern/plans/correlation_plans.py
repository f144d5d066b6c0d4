"""Queries over correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern.functions.columns import iso_text
from postern.operators import correlation as C
from postern.plans.base import query


def flat(df):
    out = df
    for name in ("observed_at", "first_observed_at", "last_observed_at"):
        if name in df.columns:
            out = out.withColumn(name, iso_text(name))
    return out


def _register(name: str) -> None:
    @query(f"corr_index_{name}")
    def run(w):
        return flat(C.index_sessions(w.sessions, (name,)))


for _name in (*C.SESSION_ENTRIES, *C.CERTIFICATE_ENTRIES):
    _register(_name)


@query("corr_index_finding")
def corr_index_finding(w):
    return flat(C.index_findings(w.findings))


@query("corr_index_anomaly_band")
def corr_index_anomaly_band(w):
    return flat(C.index_anomalies(w.anomalies))


@query("index_union")
def index_union(w):
    e = w.index_entries
    return e.groupBy(*C.KEY, "strength").agg(F.count("*").alias("entries"), F.countDistinct("session_id").alias("sessions"))


@query("correlate_case")
def correlate_case(w):
    return flat(C.correlated(w.condensed, w.members))


@query("correlation_captures")
def correlation_captures(w):
    return C.correlation_captures(w.index_entries)


@query("corr_merge_evidence")
def corr_merge_evidence(w):
    return C.merge_evidence(C._grouped(w.index_entries))


@query("correlation_id")
def correlation_id(w):
    e = w.index_entries
    return C.member_digest(C.members(e, C.shared_keys(e)))


@query("correlation_summary")
def correlation_summary(w):
    return C.correlation_summary(w.index_entries, w.sessions, w.case_captures)


@query("bounded_occurrences")
def bounded_occurrences(w):
    return flat(C.bounded_occurrences(w.index_entries)).withColumn("position", F.col("position").cast("bigint"))


@query("bounded_correlations")
def bounded_correlations(w):
    keys = C.shared_keys(w.index_entries)
    return C.bounded_correlations(keys).select(*C.KEY, F.col("position").cast("bigint").alias("position"))


@query("correlation_list")
def correlation_list(w):
    page = C.correlation_list(
        w.correlations, C.correlation_captures(w.index_entries), needles=("198.51.100", "|1"), sort="occurrences", limit=50, offset=2
    )
    return page.select("correlation_id", *C.KEY, "occurrence_count", "total")


@query("correlation_related_sessions")
def correlation_related_sessions(w):
    return C.related_sessions(w.members, w.correlations)


@query("correlation_context")
def correlation_context(w):
    """Related finding and anomaly ids, and timeline entries, of every correlation."""
    e = w.index_entries
    inside = w.members
    part = lambda df, kind: df.withColumn("kind", F.lit(kind))
    timeline = C.context_timeline(C.correlation_captures(e), w.correlations, w.case_timeline)
    return (
        part(C.context_ids(inside, w.correlations, "finding_id"), "finding")
        .unionByName(part(C.context_ids(inside, w.correlations, "anomaly_id"), "anomaly"))
        .unionByName(part(timeline.select("case_id", "correlation_id", F.col("entry_id").alias("related_id"), "position"), "timeline"))
        .withColumn("position", F.col("position").cast("bigint"))
    )


@query("correlation_graph_nodes")
def correlation_graph_nodes(w):
    return C.evidence_nodes(w.members, C.merge_evidence(w.condensed), w.correlations)


@query("case_investigation_graph")
def case_investigation_graph(w):
    nodes = C.evidence_nodes(w.members, C.merge_evidence(w.condensed), w.correlations)
    return C.investigation_graph(w.case_captures, w.correlations, w.members, nodes)
