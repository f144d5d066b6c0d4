"""Evidence graph as SQL."""

from __future__ import annotations

from oracle.drift_sql import TLSCFG, WORDS
from oracle.evidence import CTES, q, sha
from oracle.posture_sql import POINTS
from postern.functions import fixed_values as V

N = lambda prefix, text: sha(prefix, text, 12)
CAP, HOST, SES = N("capture_", "capture_id"), N("host_", "server_ip"), N("snode_", "session_id")
SEP, CEP = N("endpoint_", "concat(server_ip, '|', CAST(server_port AS VARCHAR))"), N("endpoint_", "concat(client_ip, '|', CAST(client_port AS VARCHAR))")
SADDR, CADDR = "concat(server_ip, ':', CAST(server_port AS VARCHAR))", "concat(client_ip, ':', CAST(client_port AS VARCHAR))"
PROTO, HK, CFG = N("protocol_", "protocol"), N("tlshk_", "session_id"), N("tlscfg_", TLSCFG)
CERT, FND, EVT = N("gcert_", "fingerprint_sha256"), N("fnode_", "finding_id"), N("event_", "concat(session_id, '|', CAST(seq AS VARCHAR))")
ANO, PF = N("anode_", "anomaly_id"), N("pfactor_", "concat(factor, '|', capture_id)")
FLAG = f"band IN {V.FLAGGED_BANDS}"


def node(i, kind, label, source, meta, table, where="TRUE"):
    return f"SELECT capture_id, {i} AS node_id, {q(kind)} AS node_type, {label} AS label, {source} AS source_id, {meta} AS metadata FROM {table} WHERE {where}"


def edge(s, t, kind, basis, table, where="TRUE"):
    return f"SELECT capture_id, {s} AS source_node_id, {t} AS target_node_id, {q(kind)} AS edge_type, {q(basis)} AS basis FROM {table} WHERE {where}"


CTES["nodes"] = " UNION ".join([
    node(CAP, "capture", "concat('Capture ', capture_id)", "capture_id", "''", "sessions"),
    node(SES, "session", "session_id", "session_id", "protocol", "sessions"),
    node(CEP, "endpoint", CADDR, CADDR, "''", "sessions"), node(SEP, "endpoint", SADDR, SADDR, "''", "sessions"),
    node(HOST, "host", "server_ip", "server_ip", "''", "sessions"), node(PROTO, "protocol", "upper(protocol)", "protocol", "''", "sessions"),
    node(HK, "tls_handshake", "concat('TLS ', tls_version)", N("tls_", "session_id"), "cipher_suite", "sessions", "has_handshake"),
    node(CFG, "tls_configuration", "concat('TLS ', tls_version)", TLSCFG, "cipher_suite", "sessions", "has_handshake"),
    node(CERT, "certificate", "subject", "certificate_id", "issuer", "certificates"),
    node(FND, "finding", "title", "finding_id", "severity", "findings"),
    node(EVT, "timeline_event", "type", "concat(session_id, '#', CAST(seq AS VARCHAR))", "direction", "session_events"),
    node(ANO, "anomaly", "band", "anomaly_id", "CAST(score AS VARCHAR)", "anomalies", FLAG),
    node(PF, "posture_factor", "concat(label, ': ', status)", "factor", POINTS, "posture_factors_t", "contribution_cents > 0"),
])
CTES["edges"] = " UNION ".join([
    edge(CAP, HOST, "capture_contains_host", "host observed in capture", "sessions"), edge(HOST, SEP, "host_owns_endpoint", "server endpoint on host", "sessions"),
    edge(CEP, SES, "endpoint_participates_in_session", "client endpoint", "sessions"), edge(SEP, SES, "endpoint_participates_in_session", "server endpoint", "sessions"),
    edge(SES, CEP, "session_connects_to_endpoint", "client endpoint", "sessions"), edge(SES, SEP, "session_connects_to_endpoint", "server endpoint", "sessions"),
    edge(SES, PROTO, "session_uses_protocol", "protocol identified", "sessions"),
    edge(SES, HK, "session_has_tls_handshake", "TLS handshake reconstructed", "sessions", "has_handshake"),
    edge(SES, CFG, "session_uses_tls_config", "same TLS configuration", "sessions", "has_handshake"),
    edge(CFG, HOST, "tls_config_seen_in_host", "same TLS configuration on host", "sessions", "has_handshake"),
    edge(HK, CERT, "tls_contains_certificate", "certificate chain", "certificates"),
    edge(SES, CERT, "tls_contains_certificate", "certificate fingerprint match", "certificates SEMI JOIN (SELECT capture_id, fingerprint_sha256 FROM certificates GROUP BY ALL HAVING count(*) >= 2) USING (capture_id, fingerprint_sha256)"),
    edge(SES, FND, "session_produced_finding", "rule-based finding", "findings"), edge(FND, SES, "finding_affects_session", "finding affects session", "findings"),
    edge(FND, HOST, "finding_affects_host", "finding affects host", "findings"), edge(EVT, SES, "event_belongs_to_session", "timeline event", "session_events"),
    edge(SES, ANO, "session_has_anomaly", "statistical deviation", "anomalies", FLAG), edge(ANO, SES, "anomaly_affects_session", "statistical deviation", "anomalies", FLAG),
    edge(CAP, PF, "capture_has_posture_factor", "posture factor", "posture_factors_t", "contribution_cents > 0"),
])
E = "capture_id, source_node_id, target_node_id, edge_type, basis"
SUMMARY = """
SELECT capture_id, node_type AS item, count(*) AS n, 'node_type' AS kind FROM nodes GROUP BY ALL UNION ALL SELECT capture_id, edge_type, count(*), 'edge_type' FROM edges GROUP BY ALL"""
BODIES = {
    "graph_nodes": "SELECT * FROM nodes",
    "graph_edges": "SELECT * FROM edges",
    "graph_node_ids": "SELECT DISTINCT node_id, node_type FROM nodes",
    "graph_filter": f"SELECT {E} FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.capture_id = e.capture_id AND lower(n.metadata) = 'smtp' AND n.node_id = e.source_node_id) OR EXISTS (SELECT 1 FROM nodes n WHERE n.capture_id = e.capture_id AND lower(n.metadata) = 'smtp' AND n.node_id = e.target_node_id)",
    "graph_filter_nodes": "SELECT * FROM nodes WHERE node_type = 'certificate'",
    "graph_neighbors": """
SELECT DISTINCT n.capture_id, n.node_id, e.x AS neighbor_id FROM nodes n JOIN (SELECT capture_id, source_node_id AS k, target_node_id AS x FROM edges UNION ALL SELECT capture_id, target_node_id, source_node_id FROM edges) e
ON e.capture_id = n.capture_id AND e.k = n.node_id WHERE n.node_type IN ('host', 'certificate', 'capture')""",
    "edges_from": f"SELECT {E} FROM edges SEMI JOIN (SELECT capture_id, node_id AS source_node_id FROM nodes WHERE node_type = 'tls_configuration') USING (capture_id, source_node_id)",
    "edges_to": f"SELECT {E} FROM edges SEMI JOIN (SELECT capture_id, node_id AS target_node_id FROM nodes WHERE node_type = 'host') USING (capture_id, target_node_id)",
    "get_node": f"SELECT * FROM nodes WHERE node_id IN (SELECT {FND} FROM findings WHERE severity = 'critical')",
    "graph_depth": """
WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT capture_id, source_node_id, target_node_id FROM edges),
walk AS (SELECT capture_id, node_id, 0 AS depth FROM nodes WHERE node_type = 'capture' UNION SELECT w.capture_id, l.target_node_id, w.depth + 1 FROM walk w JOIN links l ON l.capture_id = w.capture_id AND l.source_node_id = w.node_id WHERE w.depth < 6),
d AS (SELECT capture_id, node_id, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT n.capture_id, n.node_id, CAST(coalesce(d.depth, m.deepest + 1) AS BIGINT) AS depth FROM nodes n LEFT JOIN d USING (capture_id, node_id) JOIN (SELECT capture_id, max(depth) AS deepest FROM d GROUP BY ALL) m ON m.capture_id = n.capture_id""",
    "graph_size_guard": """
SELECT capture_id, node_count, node_count <= 2500 AS kept, CASE WHEN node_count > 2500 THEN concat('evidence graph omitted: ', CAST(node_count AS VARCHAR), ' nodes exceed the configured limit of 2500') END AS warning
FROM (SELECT capture_id, count(*) AS node_count FROM nodes GROUP BY ALL)""",
    "certificate_pivots": f"""
SELECT capture_id, fingerprint_sha256 AS fingerprint, count(*) AS session_count, {WORDS('server_ip')} AS host_ips, {WORDS('protocol')} AS protocols, count(DISTINCT server_ip) AS host_count
FROM certificates JOIN (SELECT session_id, server_ip, protocol FROM sessions) USING (session_id) GROUP BY ALL HAVING count(*) >= 2""",
    "tls_config_clusters": f"SELECT capture_id, {TLSCFG} AS fingerprint, tls_version, cipher_suite, key_exchange, count(*) AS sessions, count(DISTINCT server_ip) AS hosts, count(DISTINCT protocol) AS protocols FROM sessions WHERE has_handshake GROUP BY ALL",
    "tls_config_fingerprint": f"SELECT session_id, {TLSCFG} AS fingerprint FROM sessions WHERE has_handshake",
    "report_graph_summary": SUMMARY + " UNION ALL SELECT capture_id, target_node_id, count(*), 'correlated_certificate' FROM edges WHERE edge_type = 'tls_contains_certificate' GROUP BY ALL HAVING count(*) >= 2",
    "case_graph_counts": f"SELECT k.case_id, s.* FROM case_captures k JOIN ({SUMMARY}) s USING (capture_id)",
    "investigation_context": f"""
SELECT s.capture_id, s.session_id, s.protocol, s.server_ip AS host, {CADDR} AS client_endpoint, {SADDR} AS server_endpoint, CASE WHEN has_handshake THEN tls_version END AS tls_version,
  CASE WHEN has_handshake THEN {TLSCFG} END AS tls_config_id, coalesce(c.ids, '') AS certificate_ids, coalesce(f.n, 0) AS findings, f.first_finding_id, coalesce(f.refs, 0) AS evidence_refs,
  a.anomaly_id, a.score AS anomaly_score, coalesce(e.n, 0) AS timeline_events, p.n - 1 AS related_sessions
FROM sessions s LEFT JOIN (SELECT session_id, {WORDS('fingerprint_sha256')} AS ids FROM certificates GROUP BY ALL) c USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS n, min(finding_id) AS first_finding_id, CAST(sum(n_refs) AS BIGINT) AS refs FROM findings GROUP BY ALL) f USING (session_id)
LEFT JOIN (SELECT session_id, anomaly_id, score FROM anomalies) a USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM session_events GROUP BY ALL) e USING (session_id)
JOIN (SELECT capture_id, server_ip, count(*) AS n FROM sessions GROUP BY ALL) p USING (capture_id, server_ip)""",
    "citation_check": """
SELECT note_id AS context_id, concat('session_x', CAST(created_order AS VARCHAR)) AS cited_session_id, target_id AS context_session_id FROM notes WHERE target_type = 'session' AND created_order % 8 = 0""",
}
