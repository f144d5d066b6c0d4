"""Queries over the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern.operators import graph as G
from postern.operators import lookups as L
from postern.operators import reports as R
from postern.plans.base import query


@query("graph_nodes")
def graph_nodes(w):
    return G.graph_nodes(*w.graph_tables)


@query("graph_edges")
def graph_edges(w):
    return G.graph_edges(*w.graph_tables)


@query("graph_node_ids")
def graph_node_ids(w):
    return w.node_ids.select("node_id", "node_type").distinct()


@query("graph_filter")
def graph_filter(w):
    _, edges = G.graph_filter(w.nodes, w.edges, protocol="SMTP")
    return edges


@query("graph_filter_nodes")
def graph_filter_nodes(w):
    nodes, _ = G.graph_filter(w.nodes, w.edges, node_type="certificate")
    return nodes


@query("graph_neighbors")
def graph_neighbors(w):
    return G.neighbors(w.edges, w.asked_nodes("host", "certificate", "capture"))


@query("edges_from")
def edges_from(w):
    asked = w.asked_nodes("tls_configuration").select("capture_id", F.col("node_id").alias("source_node_id"))
    return L.requested(w.edges, asked, "capture_id", "source_node_id").select(*G.EDGE)


@query("edges_to")
def edges_to(w):
    asked = w.asked_nodes("host").select("capture_id", F.col("node_id").alias("target_node_id"))
    return L.requested(w.edges, asked, "capture_id", "target_node_id").select(*G.EDGE)


@query("get_node")
def get_node(w):
    asked = w.findings.where(F.col("severity") == "critical").select("capture_id", G.ids.finding_node("finding_id").alias("node_id"))
    return L.requested(w.nodes, asked, "capture_id", "node_id").select(*G.NODE)


@query("graph_depth")
def graph_depth(w):
    return G.graph_depth(w.node_ids, w.edges)


@query("graph_size_guard")
def graph_size_guard(w):
    return G.size_guard(w.node_ids, 2500)


@query("certificate_pivots")
def certificate_pivots(w):
    return G.certificate_pivots(w.sessions)


@query("tls_config_clusters")
def tls_config_clusters(w):
    return G.tls_config_clusters(w.sessions)


@query("tls_config_fingerprint")
def tls_config_fingerprint(w):
    return w.sessions.where(F.col("handshake").isNotNull()).select("session_id", G.config_fingerprint().alias("fingerprint"))


@query("report_graph_summary")
def report_graph_summary(w):
    return R.graph_summary(w.node_ids, w.edges)


@query("case_graph_counts")
def case_graph_counts(w):
    counts = R.graph_summary(w.node_ids, w.edges).where(F.col("kind") != "correlated_certificate")
    return w.case_captures.select("case_id", "capture_id").join(counts, "capture_id")


@query("investigation_context")
def investigation_context(w):
    return G.investigation_context(w.sessions, w.findings, w.anomalies, w.session_events)


@query("bounded_session_context")
def bounded_session_context(w):
    return G.bounded_session_context(w.sessions, w.findings, w.anomalies, w.session_events, L.related_by_host(w.sessions))


@query("citation_check")
def citation_check(w):
    notes = w.notes.where(F.col("target_type") == "session")
    contexts = notes.select(F.col("note_id").alias("context_id"), F.col("target_id").alias("session_id"))
    cited = notes.select(
        F.col("note_id").alias("context_id"),
        F.explode(F.array("target_id", F.when(F.col("created_order") % 8 == 0, F.concat(F.lit("session_x"), F.col("created_order").cast("string"))))).alias("cited_session_id"),
    )
    return G.citation_check(cited, contexts)
