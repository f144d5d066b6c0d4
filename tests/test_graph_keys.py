"""Nodes and edges are told apart by their keys: same rows as by their texts, fewer bytes."""

from datetime import datetime

from pyspark.sql.functions import lit

from postern.functions import ids
from postern.operators import graph as G
from postern.operators import rules
from postern.plans.workspace import Workspace

SESSION = "capture_id string, session_id string, client_ip string, client_port int, server_ip string, server_port int, protocol string, handshake struct<handshake_id: string, tls_version: string, cipher_suite: string, key_exchange: string>, certificates array<struct<certificate_id: string, fingerprint_sha256: string, subject: string, issuer: string>>"
TYPES = {n for n, _ in G.NODE_TYPES}


def tables(spark):
    chain = [("cert_1", "f1", "CN=b", "CN=ca"), (None, None, "CN=a", "CN=ca"), ("cert_1", "f1", "CN=a", "CN=ca")]
    shake = ("tls_1", "TLS 1.2", None, "RSA")
    rows = [
        ("c", "s1", "10.0.0.1", 5, "10.0.0.9", 25, "smtp", shake, chain), ("c", "s1", "10.0.0.1", 5, "10.0.0.9", 25, "smtp", shake, chain), ("c", "s1", "10.0.0.2", 5, "10.0.0.9", 25, None, None, chain),
        ("c", None, None, None, None, None, None, None, None), (None, "s2", "10.0.0.9", 25, "10.0.0.9", 25, "imap", shake, []),
    ]
    sessions = spark.createDataFrame(rows, SESSION)
    findings = spark.createDataFrame([("c", "s1", "x", "10.0.0.9", "T", "high"), ("c", "s1", "x", "10.0.0.9", "S", "high"), ("c", None, "y", None, None, None)], "capture_id string, session_id string, finding_id string, server_ip string, title string, severity string")
    events = spark.createDataFrame([("c", "s1", 0, "t", "d"), ("c", "s1", 0, "u", "d"), ("c", "s1", None, "t", None)], "capture_id string, session_id string, seq bigint, type string, direction string")
    anomalies = spark.createDataFrame([("c", "s1", "a", "highly_anomalous", 90), ("c", "s1", "b", "normal", 1)], "capture_id string, session_id string, anomaly_id string, band string, score int")
    factors = spark.createDataFrame([("c", "tls", "TLS", "weak", 1250), ("c", "auth", "Auth", "good", 0)], "capture_id string, factor string, label string, status string, contribution_cents bigint")
    return sessions, findings, events, anomalies, factors


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_ids_and_labels(spark):
    made = tables(spark)
    nodes = [tuple(r) for r in G.graph_nodes(*made).collect()]
    assert len({n[:2] for n in nodes}) == len(nodes) and {n[2] for n in nodes} == TYPES
    by_id = {n[:2]: n[2:] for n in nodes}
    assert by_id["c", one(spark, ids.certificate_node(lit("f1")))] == ("certificate", "CN=a", "cert_1", "CN=ca")
    assert by_id["c", one(spark, ids.finding_node(lit("x")))] == ("finding", "S", "x", "high")
    assert by_id["c", one(spark, ids.endpoint_node(lit("10.0.0.2"), lit(5)))] == ("endpoint", "10.0.0.2:5", "10.0.0.2:5", "")
    assert sorted(map(str, (tuple(r) for r in G.node_names(G.node_keys(*made)).collect()))) == sorted(str(n[:3]) for n in nodes)
    edges = [tuple(r) for r in G.graph_edges(*made).collect()]
    assert len(set(edges)) == len(edges)
    session, cert = one(spark, ids.session_node(lit("s1"))), one(spark, ids.certificate_node(lit("f1")))
    assert ("c", session, cert, "tls_contains_certificate", "certificate fingerprint match") in edges
    assert ("c", one(spark, ids.handshake_node(lit("s1"))), cert, "tls_contains_certificate", "certificate chain") in edges
    assert sum(e[3] == "endpoint_participates_in_session" and e[2] == session for e in edges) == 3
    known = {n[1] for n in nodes}
    assert {e[1] for e in edges} | {e[2] for e in edges} <= known


def test_edges_are_shuffled_as_keys(spark):
    plan = G.graph_edges(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan.split("Aggregate [", 1)[1].split("]", 1)[0]
    assert "kind" in grouped and len(grouped.split(",")) == 4


def test_findings_come_from_stored_hits(spark, monkeypatch):
    """Rules run once, for the hits; the findings of a workspace are read from them."""
    w = Workspace(spark, "/nowhere")
    packets = "array<int>"
    shape = f"capture_id string, session_id string, protocol string, server_ip string, server_port int, detected_at timestamp, hits array<struct<rule_id: string, variant: string, severity: string, confidence: string, observed_value: string, extra: string, own_expected: string, detail: string, evidence_refs: array<struct<source: string, packet_numbers: {packets}, detail: string>>, finding_id: string, title: string>>"
    hit = ("PLAINTEXT-001", "no-such", "high", "high", "smtp", "", None, "text", [("Session", [3, 1], "d")], "finding_1", "Title")
    w.__dict__["hits"] = spark.createDataFrame([("c", "s", "smtp", "10.0.0.9", 25, datetime(2024, 1, 1), [hit]), ("c", "t", "smtp", "10.0.0.9", 25, None, [])], shape)
    monkeypatch.setattr(rules, "session_hits", None)
    found = w.finding_rows.collect()
    assert [(r["finding_id"], r["session_id"], r["category"], r["first_packet"], r["last_packet"], r["description"]) for r in found] == [("finding_1", "s", "configuration", 1, 3, "Title: text")]


def test_rounds_of_depth_shuffle_no_links(spark, monkeypatch):
    nodes = spark.createDataFrame([("c", "r", "capture"), ("c", "a", "host"), ("c", "b", "host"), ("c", "d", "host"), ("c", "x", "host"), (None, "r", "capture")], "capture_id string, node_id string, node_type string")
    pairs = [("r", "a"), ("a", "b"), ("b", "a"), ("b", "d"), ("d", "r"), ("x", "r")]
    edges = spark.createDataFrame([("c", s, t, "t", "") for s, t in pairs], "capture_id string, source_node_id string, target_node_id string, edge_type string, basis string")
    steps, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: steps.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["capture_id"], r["node_id"]): r["depth"] for r in G.graph_depth(nodes, edges).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {("c", "r"): 0, ("c", "a"): 1, ("c", "b"): 2, ("c", "d"): 3, ("c", "x"): 4, (None, "r"): 1}
    assert len(steps) == 5 and all(plan.count("Exchange hashpartitioning") == 1 for plan in steps[1:])
