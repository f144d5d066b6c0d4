"""Correlation as SQL."""

from __future__ import annotations

from oracle.digests import tree_sql
from oracle.evidence import CTES, iso, q, sha
from postern.functions import fixed_values as V
from postern.operators.correlation import DIGEST_LEAF

K = "case_id, correlation_type, evidence_key"
B = lambda c: f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE 'None' END"
STATE = (
    "CASE WHEN NOT has_starttls THEN 'none' ELSE concat('adv=', CAST(CAST(coalesce(advertised, FALSE) AS INT) AS VARCHAR), "
    "':req=', CAST(CAST(coalesce(requested, FALSE) AS INT) AS VARCHAR), ':resp=', CAST(CAST(coalesce(response_seen, FALSE) AS INT) AS VARCHAR)) END"
)
CONFIG = sha("tlscfg_", "concat(lower(tls_version), '|', lower(cipher_suite), '|', lower(key_exchange))", 12)


def pairs(**fields) -> str:
    """JSON text of the (field, value) list, NULL values left out."""
    items = ", ".join(
        f"CASE WHEN {v} IS NOT NULL THEN concat('{{\"k\":\"{k}\",\"v\":\"', CAST({v} AS VARCHAR), '\"}}') END" for k, v in fields.items()
    )
    return f"concat('[', array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ','), ']')"


def entry(kind, strength, key, source, where="TRUE", at="started_at", finding="''", anomaly="''", **fields) -> str:
    return (
        f"SELECT capture_id, session_id, {finding} AS finding_id, {anomaly} AS anomaly_id, {at} AS observed_at, "
        f"{q(kind)} AS correlation_type, {q(strength)} AS strength, {key} AS evidence_key, {pairs(**fields)} AS evidence "
        f"FROM {source} WHERE {where}"
    )


ENTRIES = {
    "host": entry("shared_host", "direct", "concat('host|', server_ip)", "sessions", ip="server_ip"),
    "endpoint": entry("shared_endpoint", "direct", "concat('endpoint|', server_ip, '|', CAST(server_port AS VARCHAR))", "sessions", ip="server_ip", port="server_port"),
    "protocol": entry("shared_protocol", "derived", "concat('protocol|', protocol)", "sessions", "protocol IS NOT NULL", protocol="protocol"),
    "tls_config": entry(
        "shared_tls_configuration", "direct", f"concat('tls-config|', {CONFIG})", "sessions", "has_handshake",
        tls_version="lower(tls_version)", cipher_suite="lower(cipher_suite)", key_exchange="lower(key_exchange)", config_fingerprint=CONFIG,
    ),
    "sni": entry("shared_evidence", "derived", "concat('sni|', lower(sni))", "sessions", "has_handshake AND sni IS NOT NULL", subtype="'server_name_indication'", server_name="lower(sni)"),
    "session_pattern": entry(
        "repeated_session_pattern", "derived",
        f"concat('session-pattern|', coalesce(protocol, 'unknown'), '|implicit=', {B('implicit_tls')}, '|starttls=', {STATE}, '|tls=', "
        f"coalesce(lower(tls_version), 'none'), '|complete=', CASE WHEN has_handshake THEN {B('handshake_complete')} ELSE 'none' END)",
        "sessions", protocol="coalesce(protocol, 'unknown')", implicit_tls=B("implicit_tls"), starttls=STATE,
        tls_version="coalesce(lower(tls_version), 'none')",
        handshake_complete=f"CASE WHEN handshake_complete IS NOT NULL THEN {B('handshake_complete')} END",
    ),
    "certificate": entry("shared_certificate", "direct", "concat('certificate|', fingerprint_sha256)", "certificates", fingerprint_sha256="fingerprint_sha256", subject="subject", issuer="issuer"),
    "cert_subject": entry("shared_certificate_subject", "derived", "concat('certificate-subject|', lower(subject))", "certificates", subject="lower(subject)"),
    "cert_issuer": entry("shared_evidence", "derived", "concat('certificate-issuer|', lower(issuer))", "certificates", subtype="'certificate_issuer'", issuer="lower(issuer)"),
    "finding": entry("shared_finding", "direct", "concat('finding-rule|', lower(rule_id))", "findings", at="detected_at", finding="finding_id", rule_id="rule_id", severity="severity"),
    "anomaly_band": entry(
        "shared_anomaly_pattern", "derived", "concat('anomaly-band|', coalesce(band, status))", "anomalies",
        f"coalesce(band, status) IN {V.FLAGGED_BANDS}", at="CAST(NULL AS TIMESTAMP)", anomaly="anomaly_id", band="coalesce(band, status)",
    ),
}
CTES["index_entries"] = (
    "SELECT e.*, c.case_id, c.idx FROM (" + " UNION ALL ".join(ENTRIES.values()) + ") e JOIN case_captures c USING (capture_id)"
)
CTES["shared_keys"] = f"""
SELECT {K}, min(strength) AS strength, count(*) AS occurrence_count, count(DISTINCT capture_id) AS capture_count,
  count(DISTINCT session_id) FILTER (session_id <> '') AS session_count, min(observed_at) AS first_at, max(observed_at) AS last_at
FROM index_entries GROUP BY {K} HAVING count(DISTINCT capture_id) >= 2"""
CTES["members"] = f"""
SELECT DISTINCT {K}, capture_id, session_id, finding_id, anomaly_id FROM index_entries SEMI JOIN shared_keys USING ({K})"""
CTES["member_items"] = f"""
SELECT {K}, occurrence_count AS n, concat_ws('|', nullif(capture_id, ''), nullif(session_id, ''), nullif(finding_id, ''), nullif(anomaly_id, '')) AS item
FROM members JOIN shared_keys USING ({K})"""
CTES["digests"] = f"""
SELECT {K}, concat('corr_', substr(sha256(concat_ws('|', {K}, text)), 1, 16)) AS correlation_id FROM ({tree_sql('member_items', K, DIGEST_LEAF)})"""
CTES["evidence_fields"] = f"""
SELECT {K}, rk, json_extract_string(f, '$.k') AS field, json_extract_string(f, '$.v') AS value FROM (
  SELECT {K}, (idx, coalesce(observed_at, TIMESTAMP '9999-01-01'), session_id, finding_id, anomaly_id) AS rk,
    unnest(CAST(evidence AS JSON[])) AS f FROM index_entries)"""
CTES["merged_evidence"] = f"""
SELECT {K}, field, arg_min(value, rk) AS value FROM evidence_fields GROUP BY {K}, field
UNION ALL
SELECT {K}, concat(field, '_observed'), array_to_string(list_slice(list_sort(list_distinct(list(value))), 1, {V.MAX_OBSERVED_VALUES}), ', ')
FROM evidence_fields GROUP BY {K}, field HAVING count(DISTINCT value) > 1"""
CTES["correlations"] = f"""
SELECT correlation_id, {K}, strength, m.evidence, occurrence_count, capture_count, session_count, first_at, last_at
FROM shared_keys JOIN digests USING ({K}) LEFT JOIN (
  SELECT {K}, array_to_string(list_sort(list(concat(field, '=', value))), '; ') AS evidence FROM merged_evidence GROUP BY {K}) m USING ({K})"""
CTES["corr_captures"] = f"SELECT DISTINCT {K}, capture_id FROM members"
CTES["fields_map"] = f"""
SELECT {K}, max(value) FILTER (field = 'ip') AS ip, max(value) FILTER (field = 'port') AS port,
  max(value) FILTER (field = 'subject') AS subject FROM merged_evidence GROUP BY {K}"""
TAIL = "substr(evidence_key, instr(evidence_key, '|') + 1)"
N12 = lambda prefix, text: sha(prefix, text, 12)
CTES["corr_nodes"] = f"""
SELECT case_id, correlation_id, node_id, node_type, label FROM (
  SELECT case_id, correlation_id,
    CASE correlation_type WHEN 'shared_certificate' THEN {N12('gcert_', TAIL)} WHEN 'shared_certificate_subject' THEN {N12('gcert_', TAIL)}
      WHEN 'shared_tls_configuration' THEN {N12('tlscfg_', TAIL)} WHEN 'shared_host' THEN {N12('host_', TAIL)}
      WHEN 'shared_endpoint' THEN {N12('endpoint_', "concat(ip, '|', port)")} WHEN 'shared_protocol' THEN {N12('protocol_', TAIL)} END AS node_id,
    CASE correlation_type WHEN 'shared_certificate' THEN 'certificate' WHEN 'shared_certificate_subject' THEN 'certificate'
      WHEN 'shared_tls_configuration' THEN 'tls_configuration' WHEN 'shared_host' THEN 'host' WHEN 'shared_endpoint' THEN 'endpoint' ELSE 'protocol' END AS node_type,
    CASE correlation_type WHEN 'shared_certificate' THEN left({TAIL}, 16) WHEN 'shared_certificate_subject' THEN left(subject, 64)
      WHEN 'shared_endpoint' THEN concat(ip, ':', port) ELSE {TAIL} END AS label
  FROM correlations JOIN fields_map USING ({K})) WHERE node_id IS NOT NULL
UNION ALL
SELECT case_id, correlation_id, {N12('fnode_', 'finding_id')}, 'finding', finding_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY capture_id, session_id, finding_id) AS n FROM members WHERE finding_id <> '') JOIN digests USING ({K}) WHERE n <= {V.MAX_OCCURRENCES}
UNION ALL
SELECT case_id, correlation_id, {N12('anode_', 'anomaly_id')}, 'anomaly', anomaly_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY capture_id, session_id, anomaly_id) AS n FROM members WHERE anomaly_id <> '') JOIN digests USING ({K}) WHERE n <= {V.MAX_OCCURRENCES}"""

BODIES = {
    f"corr_index_{name}": f"SELECT * REPLACE ({iso('observed_at')} AS observed_at) FROM ({sql})" for name, sql in ENTRIES.items()
}
BODIES["index_union"] = f"SELECT {K}, strength, count(*) AS entries, count(DISTINCT session_id) AS sessions FROM index_entries GROUP BY ALL"
BODIES["correlate_case"] = f"SELECT * EXCLUDE (first_at, last_at), {iso('first_at')} AS first_observed_at, {iso('last_at')} AS last_observed_at FROM correlations"
BODIES["correlation_captures"] = "SELECT * FROM corr_captures"
BODIES["corr_merge_evidence"] = "SELECT * FROM merged_evidence"
BODIES["correlation_id"] = "SELECT * FROM digests"
BODIES["correlation_summary"] = f"""
SELECT c.case_id, c.capture_count, c.sessions_scanned, k.index_keys, t.correlation_type, t.correlations FROM (
  SELECT case_id, count(DISTINCT capture_id) AS capture_count, count(session_id) AS sessions_scanned
  FROM case_captures LEFT JOIN sessions USING (capture_id) GROUP BY case_id) c
LEFT JOIN (SELECT case_id, count(*) AS index_keys FROM (SELECT DISTINCT {K} FROM index_entries) GROUP BY case_id) k USING (case_id)
LEFT JOIN (SELECT case_id, correlation_type, count(*) AS correlations FROM shared_keys GROUP BY ALL) t USING (case_id)"""
BODIES["bounded_occurrences"] = f"""
SELECT {K}, capture_id, session_id, finding_id, anomaly_id, {iso('observed_at')} AS observed_at, position FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY capture_id, session_id, finding_id, anomaly_id) AS position FROM index_entries SEMI JOIN shared_keys USING ({K}))
WHERE position <= {V.MAX_OCCURRENCES}"""
BODIES["bounded_correlations"] = f"""
SELECT * FROM (SELECT {K}, row_number() OVER (PARTITION BY case_id ORDER BY correlation_type, evidence_key) AS position FROM shared_keys) WHERE position <= {V.MAX_CORRELATIONS}"""
BODIES["correlation_list"] = f"""
SELECT correlation_id, {K}, occurrence_count, count(*) OVER () AS total FROM correlations
WHERE contains(lower(evidence_key), '198.51.100') AND contains(lower(evidence_key), '|1')
ORDER BY occurrence_count DESC, correlation_id LIMIT 50 OFFSET 2"""
BODIES["correlation_related_sessions"] = f"""
SELECT case_id, session_id, capture_id, correlation_id, correlation_type, evidence_key, session_count - 1 AS other_session_count,
  capture_count - 1 AS other_capture_count FROM (SELECT DISTINCT {K}, capture_id, session_id FROM members WHERE session_id <> '')
JOIN correlations USING ({K})"""
_ids = lambda col, kind: f"""SELECT case_id, correlation_id, {col} AS related_id, position, '{kind}' AS kind FROM (
  SELECT {K}, {col}, row_number() OVER (PARTITION BY {K} ORDER BY {col}) AS position FROM (SELECT DISTINCT {K}, {col} FROM members WHERE {col} <> ''))
  JOIN digests USING ({K}) WHERE position <= {V.MAX_RELATED_IDS}"""  # noqa: E731
BODIES["correlation_context"] = f"""
{_ids('finding_id', 'finding')} UNION ALL {_ids('anomaly_id', 'anomaly')} UNION ALL
SELECT case_id, correlation_id, entry_id, position, 'timeline' FROM (
  SELECT {', '.join('c.' + k for k in K.split(', '))}, t.entry_id, row_number() OVER (PARTITION BY c.case_id, c.correlation_type, c.evidence_key ORDER BY t.insert_order) AS position
  FROM corr_captures c JOIN case_timeline t ON t.case_id = c.case_id AND t.detail_capture_id = c.capture_id) JOIN digests USING ({K})
WHERE position <= {V.MAX_RELATED_IDS}"""
BODIES["correlation_graph_nodes"] = "SELECT * FROM corr_nodes"
_SN = sha("snode_", "session_id", 12)
BODIES["case_investigation_graph"] = f"""
WITH named AS (SELECT DISTINCT {K}, capture_id, session_id, correlation_id FROM members JOIN digests USING ({K}) WHERE session_id <> ''),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ct, ek, session_id) AS n FROM (
  SELECT case_id, session_id, min((correlation_type, evidence_key)) AS a, min(correlation_type) AS ct, arg_min(evidence_key, (correlation_type, evidence_key)) AS ek,
    min(capture_id) AS capture_id FROM named GROUP BY ALL)) WHERE n <= {V.MAX_GRAPH_SESSIONS})
SELECT case_id, concat('case_', case_id) AS source_node_id, concat('capture_', capture_id) AS target_node_id, 'case_contains_capture' AS edge_type, 'correlation' AS layer, 'case attachment reference' AS basis FROM case_captures
UNION SELECT case_id, concat('case_', case_id), concat('correlation_', correlation_id), 'case_groups_correlation', 'correlation', 'shared evidence observation' FROM digests
UNION SELECT case_id, concat('capture_', capture_id), {_SN}, 'capture_contains_session', 'forensic', 'analysis record' FROM kept
UNION SELECT case_id, concat('correlation_', correlation_id), {_SN}, 'correlation_involves_session', 'correlation', 'shared evidence observation' FROM named SEMI JOIN kept USING (case_id, session_id)
UNION SELECT case_id, concat('correlation_', correlation_id), node_id, 'correlation_explained_by_evidence', 'correlation', 'shared evidence observation' FROM corr_nodes"""
