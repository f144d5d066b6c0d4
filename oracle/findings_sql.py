from __future__ import annotations

from oracle.evidence import iso, q
from oracle.findings import findings_sql
from postern.functions import fixed_values as V
from postern.plans.findings_plans import RULE_QUERIES

FLAT = f"""finding_id, capture_id, session_id, protocol, server_ip, rule_id, title, severity, confidence, category,
  observed_value, expected_value, action, target, rationale, priority, standard_name, n_refs, first_packet, last_packet,
  {iso('detected_at')} AS detected_at"""

BODIES = {
    name: f"SELECT {FLAT} FROM ({findings_sql([rule])})" for name, rule in RULE_QUERIES.items()
}
BODIES["evaluate_all_rules"] = f"SELECT {FLAT} FROM findings"
BODIES["finding_id"] = "SELECT finding_id, rule_id, session_id, TRUE AS session_shape_valid FROM findings"
BODIES["policy_override"] = f"SELECT {FLAT} FROM ({findings_sql(V.FACTOR_BY_RULE, 'TLS 1.3', 4096)})"
BODIES["rule_registry"] = f"""
SELECT {FLAT} FROM findings WHERE rule_id = 'PLAINTEXT-001'
UNION ALL
SELECT concat('finding_', substr(sha256(concat('BULK-001|', session_id, '|', CAST(bytes_server_to_client AS VARCHAR), '|')), 1, 12)),
  capture_id, session_id, protocol, server_ip, 'BULK-001', 'Large server payload', 'info', 'low', 'other',
  CAST(bytes_server_to_client AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, {iso('ended_at')}
FROM sessions WHERE bytes_server_to_client > 50000"""
BODIES["evidence_flags"] = f"""
SELECT session_id, coalesce(key_exchange IN {V.FORWARD_SECRET_KEY_EXCHANGES}, FALSE) AS forward_secrecy_flag,
  coalesce(tls_version IN {V.DEPRECATED_TLS_VERSIONS}, FALSE) AS deprecated_version_flag,
  started_at > leaf_after AS cert_is_expired FROM judged"""
