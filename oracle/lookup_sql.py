"""Scalars, lists, lookups, joins and reports as SQL."""

from __future__ import annotations

from oracle.correlation_sql import STATE
from oracle.digests import tree_sql
from oracle.evidence import CTES, bands_sql, case_sql, half_even, iso, key_exchange, q, suite_class
from oracle.posture_sql import SEV_RANK, STATUS
from postern.functions import fixed_values as V
from postern.operators.reports import EVIDENCE_LEAF

S = "session_id, capture_id, protocol, server_ip, server_port"
FND = "finding_id, capture_id, session_id, rule_id, severity"
POS = case_sql("severity", {s: i for i, s in enumerate(V.SEVERITY_ORDER)}, "99")
CTES["remediations"] = """
SELECT concat('rem_', substr(sha256(concat(case_id, '|', rule_id)), 1, 16)) AS remediation_id, case_id, rule_id, 'finding' AS target_type,
  finding_id AS target_id, title, '' AS description, action AS recommended_action,
  ['OPEN', 'PLANNED', 'IN_PROGRESS', 'BLOCKED', 'COMPLETED', 'CANCELLED'][1 + n % 6] AS status,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][1 + n % 4] AS priority, ['ops', 'Sec Team', ''][1 + n % 3] AS owner,
  CASE WHEN n % 3 <> 0 THEN concat('2024-03-', lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')) END AS due_at,
  concat('2024-02-', lpad(CAST(1 + n % 27 AS VARCHAR), 2, '0')) AS updated_at,
  ['NOT_VERIFIED', 'PENDING', 'VERIFIED', 'FAILED', 'INCONCLUSIVE'][1 + n % 5] AS verification_status, n
FROM (SELECT case_id, rule_id, min(finding_id) AS finding_id, arg_min(title, finding_id) AS title, arg_min(action, finding_id) AS action,
    arg_min(length(title), finding_id) + length(rule_id) AS n
  FROM findings JOIN case_captures USING (capture_id) WHERE idx = 0 GROUP BY case_id, rule_id)"""
IP = "concat('10.', CAST(n_chars % 300 AS VARCHAR), '.7.1')"
LINE = "concat(CASE turn % 3 WHEN 0 THEN 'auth ' WHEN 1 THEN 'Pass  ' ELSE '' END, text)"
CTRL = "'[\\x00-\\x1f\\x7f]'"
SAFE = lambda t: f"left(regexp_replace({t}, {CTRL}, '', 'g'), 512)"
STRIPPED = f"regexp_replace({LINE}, '^\\s+|\\s+$', '', 'g')"
WORD = f"upper(regexp_extract({STRIPPED}, '^\\S*'))"
ARGS = f"regexp_replace({STRIPPED}, '^\\S*\\s*', '')"
SECRET = f"{WORD} IN {V.SENSITIVE_COMMANDS}"
VALID = "contains(n, '/') OR contains(n, '..') OR contains(n, chr(92))"

BODIES = {
    "normalizers": f"""
SELECT doc_id, CASE WHEN n_chars % 300 <= 255 THEN {IP} END AS ip, CASE WHEN n_chars - 100 BETWEEN 0 AND 65535 THEN n_chars - 100 END AS port,
  CASE WHEN lower(source) IN ('smtp', 'imap', 'pop3') THEN lower(source) END AS protocol, concat('host-', lower(lang), '.example.org') AS hostname,
  concat('tls ', lower(lang)) AS token, concat('abcd', lower(to_hex(doc_id))) AS fingerprint,
  concat('cn=', lower(source), ' x') AS subject, concat('key|', lang) AS evidence_key FROM documents""",
    "line_scalars": f"""
SELECT conv_id, turn, role, md5({SAFE(LINE)}) AS safe, {WORD} AS command, length({ARGS}) AS argument_length,
  md5(CASE WHEN {SECRET} AND {ARGS} <> '' THEN concat({WORD}, ' redacted') ELSE {SAFE(LINE)} END) AS redacted,
  length(CASE WHEN {SECRET} THEN 'redacted' ELSE {SAFE(ARGS)} END) AS redacted_length FROM conversations""",
    "session_scalars": f"""
SELECT session_id, cipher_suite AS suite_name, {key_exchange('cipher_suite')} AS suite_key_exchange,
  concat('host_', substr(sha256(server_ip), 1, 12)) AS host_id, {iso('started_at')} AS started_text, duration_seconds AS duration,
  CAST(epoch(leaf_after) - epoch(started_at) AS DOUBLE) / 86400 AS validity_days,
  concat(protocol, '|', server_ip, '|', CAST(server_port AS VARCHAR)) AS endpoint, {STATE} AS starttls_state,
  {case_sql('server_port', V.PORT_PROTOCOLS)} AS port_protocol, server_port IN {V.IMPLICIT_TLS_PORTS} AS port_implicit,
  CAST(bytes_server_to_client AS DOUBLE) AS safe_bytes FROM judged""",
    "epoch_to_timestamp": f"SELECT event_id, {iso('make_timestamp((event_id * 1000 + 500000000) * 1000000)')} AS at FROM events",
    "threshold_labels": f"""
SELECT p_partkey, {bands_sql('s', V.POSTURE_BANDS, V.LOWEST_POSTURE_BAND)} AS posture_state, {bands_sql('s', V.ANOMALY_BANDS, 'normal')} AS anomaly_band,
  {STATUS('s % 6 - 1')} AS factor_status, CASE WHEN s / 50 >= 1 THEN 'high' WHEN s / 50 >= 0.5 THEN 'moderate' ELSE 'low' END AS deviation,
  CASE WHEN s & 31 = 0 THEN 'none' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN s & {b} <> 0 THEN '{n}' END" for b, n in V.TCP_FLAGS)}], lambda x: x IS NOT NULL), '+') END AS tcp_flags_label,
  {case_sql('s', V.LINK_TYPE_NAMES, "concat('linktype ', CAST(s AS VARCHAR))")} AS link_type, {case_sql('s + 700', V.TLS_VERSION_CODES, "'unknown'")} AS version
FROM (SELECT p_partkey, CAST(p_partkey % 101 AS INT) AS s FROM part)""",
    "rank_labels": f"SELECT finding_id, CAST({SEV_RANK} AS BIGINT) AS severity_rank, CAST({case_sql('confidence', V.CONFIDENCE_RANKS, '0')} AS BIGINT) AS confidence_rank FROM findings",
    "id_shape_valid": "SELECT note_id, " + ", ".join(f"regexp_matches(target_id, {q(V.ID_SHAPES[k])}) AS is_{k}" for k in ("capture", "session", "correlation", "drift", "remediation")) + " FROM notes",
    "strip_sensitive_keys": """
SELECT conv_id, turn, role, array_to_string(list_sort(list_filter([role, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'note' END, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'topic' END], lambda x: x IS NOT NULL)), ',') AS kept FROM conversations""",
    "capture_identity": "SELECT doc_id, sha256(text) AS sha256, concat('capture_', substr(sha256(text), 1, 12)) AS capture_id FROM documents",
    "capture_dedup": """
SELECT upload_id, sha256, concat('capture_', substr(sha256, 1, 12)) AS capture_id, row_number() OVER (PARTITION BY sha256 ORDER BY ingested_at, upload_id) > 1 AS duplicate
FROM (SELECT doc_id AS upload_id, sha256(text) AS sha256, doc_id % 7 AS ingested_at FROM documents)""",
    "filename_valid": f"""
SELECT page_id, length(n) > 0 AND length(n) <= 255 AND NOT ({VALID}) AND (ends_with(lower(n), '.pcap') OR ends_with(lower(n), '.pcapng')) AS valid FROM (
  SELECT page_id, trim(concat(CASE WHEN page_id % 2 = 0 THEN string_split(url, '/')[-1] ELSE url END, CASE page_id % 3 WHEN 0 THEN '.PCAP' WHEN 1 THEN '.pcapng' ELSE '.txt' END)) AS n FROM pages)""",
    "src_case_evidence": """
SELECT session_id, capture_id, protocol, packet_count FROM sessions WHERE capture_id IN (SELECT capture_id FROM case_captures JOIN cases USING (case_id) WHERE status = 'OPEN')""",
    "src_evidence_tables": "SELECT capture_id, protocol, count(*) AS sessions, CAST(sum(packet_count) AS BIGINT) AS packets FROM sessions GROUP BY ALL",
    "analysis_status": """
SELECT c.capture_id, coalesce(a.status, 'not_analyzed') AS status, a.warning, CASE WHEN a.status = 'completed' THEN coalesce(s.n, 0) ELSE 0 END AS session_count
FROM captures c LEFT JOIN analysis a USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n FROM sessions GROUP BY ALL) s USING (capture_id)""",
    "capture_list": f"SELECT c.capture_id, c.filename, {iso('ingested_at')} AS ingested_at, coalesce(a.status, 'not_analyzed') AS analysis_status FROM captures c LEFT JOIN analysis a USING (capture_id)",
    "sessions_by_capture": f"SELECT {S} FROM sessions SEMI JOIN case_captures USING (capture_id)",
    "findings_by_capture": f"SELECT {FND} FROM findings SEMI JOIN case_captures USING (capture_id)",
    "findings_by_session": f"SELECT {FND} FROM findings WHERE session_id IN (SELECT target_id FROM notes WHERE target_type = 'session')",
    "finding_by_id": f"SELECT {FND} FROM findings SEMI JOIN (SELECT DISTINCT target_id AS finding_id FROM remediations) USING (finding_id)",
    "anomalies_by_capture": "SELECT * FROM anomalies SEMI JOIN case_captures USING (capture_id)",
    "anomaly_by_session": "SELECT * FROM anomalies WHERE session_id IN (SELECT target_id FROM notes WHERE target_type = 'session')",
    "anomaly_by_id": "SELECT * FROM anomalies WHERE session_id IN (SELECT session_id FROM findings WHERE severity = 'critical')",
    "cases_by_status": "SELECT * FROM cases WHERE status = 'OPEN'",
    "finding_list": f"""SELECT {FND}, CAST({POS} AS BIGINT) AS severity_position FROM findings WHERE confidence = 'high'
      AND (contains(lower(title), 'cert') OR contains(lower(rule_id), 'cert') OR contains(session_id, 'cert'))""",
    "anomaly_list": f"SELECT anomaly_id, session_id, CAST({case_sql('coalesce(band, status)', {b: i for i, b in enumerate(V.ANOMALY_BAND_ORDER)}, '99')} AS BIGINT) AS band_position, CAST(coalesce(score, -1) AS BIGINT) AS sort_score FROM anomalies WHERE protocol = 'smtp'",
    "facet_values": "SELECT DISTINCT category AS value FROM findings WHERE category <> ''",
    "remediation_list": f"""
SELECT remediation_id, case_id, rule_id, priority, status, count(*) OVER () AS total FROM remediations
WHERE contains(lower(concat(title, ' ', description, ' ', owner, ' ', target_id, ' ', rule_id)), 'cert')
ORDER BY {case_sql('priority', V.PRIORITY_RANKS, '4')}, remediation_id LIMIT 20 OFFSET 1""",
    "remediations_for_finding": "SELECT remediation_id, case_id, target_id, status FROM remediations",
    "posture_hosts_list": "SELECT capture_id, host_id, ip, highest_severity FROM posture_hosts_t WHERE affected",
    "posture_protocols_list": "SELECT capture_id, protocol, status FROM posture_protocols_t",
    "posture_priorities_list": "SELECT capture_id, position, rule_id, priority_cents FROM posture_priorities_t",
    "case_activity_lists": """
SELECT case_id, 'timeline' AS kind, entry_id AS record_id, insert_order AS n FROM case_timeline UNION ALL SELECT case_id, 'note', note_id, created_order FROM notes
UNION ALL SELECT case_id, 'bookmark', bookmark_id, 0 FROM bookmarks""",
    "host_detail": """
SELECT s.capture_id, concat('host_', substr(sha256(s.server_ip), 1, 12)) AS host_id, s.server_ip, s.session_id, count(f.finding_id) AS findings
FROM sessions s LEFT JOIN findings f USING (session_id) GROUP BY ALL""",
    "join_cipher_class": f"SELECT session_id, code, cipher_suite, {suite_class('code')} AS cipher_class FROM sessions WHERE code IS NOT NULL",
    "join_severity_weight": f"""SELECT finding_id, {case_sql('severity', V.SEVERITY_WEIGHTS, '0')} AS weight, {case_sql('confidence', V.CONFIDENCE_QUARTERS, '1')} AS confidence_quarters,
      {case_sql('rule_id', V.FACTOR_BY_RULE, "'other'")} AS factor FROM findings""",
    "join_findings_sessions": "SELECT f.finding_id, f.session_id, concat('host_', substr(sha256(s.server_ip), 1, 12)) AS host_id, s.client_ip FROM findings f JOIN sessions s USING (session_id)",
    "join_leaf_certificate": "SELECT s.capture_id, s.session_id, c.certificate_id, c.subject, c.issuer FROM sessions s LEFT JOIN (SELECT * FROM certificates WHERE position_in_chain = 0) c USING (session_id)",
    "join_cert_validity_interval": "SELECT session_id, certificate_id, started_at BETWEEN not_before AND not_after AS valid FROM certificates",
    "join_sni_san": "SELECT session_id, sni, array_to_string(sans, ', ') AS sans FROM judged WHERE session_id IN (SELECT session_id FROM findings WHERE rule_id = 'CERT-IDENTITY-001')",
    "join_related_sessions": """
SELECT s.capture_id, s.server_ip, s.session_id, m.n - 1 AS related_count, array_to_string(list_slice(list_filter(m.head, lambda x: x <> s.session_id), 1, 5), ',') AS first_related
FROM sessions s JOIN (SELECT capture_id, server_ip, count(*) AS n, list_sort(list(session_id))[1:6] AS head FROM sessions GROUP BY ALL) m USING (capture_id, server_ip)""",
    "join_host_sessions_semi": f"""
SELECT {FND} FROM findings WHERE session_id IN (SELECT session_id FROM sessions SEMI JOIN (
  SELECT capture_id, server_ip FROM sessions GROUP BY ALL HAVING max(bytes_server_to_client) > 80000) USING (capture_id, server_ip))""",
    "join_unattached_captures": "SELECT c.case_id, k.capture_id FROM cases c CROSS JOIN captures k ANTI JOIN case_captures a ON a.case_id = c.case_id AND a.capture_id = k.capture_id",
    "join_import_captures": """
SELECT s_suppkey, capture_id, s_suppkey % 4 <> 0 AS attached, CASE WHEN s_suppkey % 4 = 0 THEN concat('capture not available locally: ', capture_id) END AS warning
FROM supplier JOIN captures ON s_nationkey = cap""",
    "join_reference_integrity": """
SELECT record_id, target_type, target_id FROM (SELECT note_id AS record_id, target_type, target_id FROM notes UNION ALL SELECT bookmark_id, target_type, target_id FROM bookmarks)
WHERE NOT CASE target_type WHEN 'session' THEN target_id IN (SELECT session_id FROM sessions) WHEN 'finding' THEN target_id IN (SELECT finding_id FROM findings)
  WHEN 'capture' THEN target_id IN (SELECT capture_id FROM captures) ELSE target_id IN (SELECT case_id FROM cases) END""",
    "report_executive_summary": f"""
WITH g AS (SELECT capture_id, section, item FROM captures CROSS JOIN (VALUES {', '.join([f"('severity', '{s}')" for s in V.SEVERITY_ORDER] + [f"('band', '{b}')" for b in V.ANOMALY_BAND_ORDER] + [f"('total', '{t}')" for t in ('sessions', 'findings', 'anomalies')])}) t(section, item)),
c AS (SELECT capture_id, 'severity' AS section, severity AS item, count(*) AS n FROM findings GROUP BY ALL
  UNION ALL SELECT capture_id, 'band', coalesce(band, status), count(*) FROM anomalies GROUP BY ALL
  UNION ALL SELECT capture_id, 'total', 'sessions', count(*) FROM sessions GROUP BY ALL
  UNION ALL SELECT capture_id, 'total', 'findings', count(*) FROM findings GROUP BY ALL
  UNION ALL SELECT capture_id, 'total', 'anomalies', count(*) FROM anomalies GROUP BY ALL)
SELECT capture_id, section, item, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (capture_id, section, item)
UNION ALL SELECT capture_id, 'protocol', protocol, count(*) FROM sessions GROUP BY ALL""",
    "report_tls_coverage": """
SELECT capture_id, count(*) AS sessions_total, count(*) FILTER (has_handshake) AS sessions_with_tls_handshake, count(*) FILTER (has_starttls) AS sessions_with_starttls,
  count(*) FILTER (handshake_complete) AS handshakes_complete FROM sessions GROUP BY capture_id""",
    "report_tls_summary": """
WITH hs AS (SELECT * FROM sessions WHERE has_handshake)
SELECT capture_id, 'version' AS facet, tls_version AS item, count(*) AS n FROM hs GROUP BY ALL
UNION ALL SELECT capture_id, 'cipher_family', string_split(cipher_suite, '_')[1], count(*) FROM hs GROUP BY ALL
UNION ALL SELECT capture_id, 'key_exchange', key_exchange, count(*) FROM hs GROUP BY ALL
UNION ALL SELECT capture_id, 'handshake', CASE WHEN handshake_complete THEN 'complete' ELSE 'incomplete' END, count(*) FROM hs GROUP BY ALL
UNION ALL SELECT capture_id, 'incomplete_reason', coalesce(handshake_reason, 'unspecified'), count(*) FROM hs WHERE NOT handshake_complete GROUP BY ALL""",
    "report_certificate_inventory": """
SELECT capture_id, fingerprint_sha256, count(*) AS presentations, any_value(subject) AS subject, any_value(issuer) AS issuer, any_value(signature_algorithm) AS signature_algorithm,
  any_value(public_key_algorithm) AS public_key_algorithm, any_value(public_key_size_bits) AS public_key_size_bits, any_value(position_in_chain) AS position_in_chain
FROM certificates GROUP BY capture_id, fingerprint_sha256""",
    "report_findings_section": f"""
SELECT capture_id, position, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {POS}, session_id, rule_id, finding_id) AS position FROM findings) WHERE position <= 500""",
    "case_report_findings_section": f"""
SELECT case_id, position, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {POS}, capture_id, rule_id, finding_id) AS position
  FROM findings JOIN case_captures USING (capture_id)) WHERE position <= 2000""",
    "report_anomaly_section": """
SELECT capture_id, coalesce(band, status) AS band, count(*) AS items, count(*) FILTER (n <= 500) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY protocol, session_id) AS n FROM anomalies) GROUP BY ALL""",
    "protocol_distribution": "SELECT capture_id, protocol, count(*) AS sessions FROM sessions GROUP BY ALL",
    "case_summary": """
SELECT k.case_id, k.capture_id, TRUE AS available, c.filename, coalesce(a.status, 'not_analyzed') AS analysis_status, coalesce(s.n, 0) AS session_count, coalesce(f.n, 0) AS findings_count,
  coalesce(x.n, 0) AS anomalies_count, p.posture_state, p.overall_score FROM case_captures k JOIN captures c USING (capture_id) LEFT JOIN analysis a USING (capture_id)
LEFT JOIN (SELECT capture_id, count(*) AS n FROM sessions GROUP BY ALL) s USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n FROM findings GROUP BY ALL) f USING (capture_id)
LEFT JOIN (SELECT capture_id, count(*) AS n FROM anomalies GROUP BY ALL) x USING (capture_id) LEFT JOIN posture p USING (capture_id)""",
    "case_counts": """
SELECT case_id, count(*) AS n, 'captures' AS item FROM case_captures GROUP BY ALL UNION ALL SELECT case_id, count(*), 'notes' FROM notes GROUP BY ALL
UNION ALL SELECT case_id, count(*), 'bookmarks' FROM bookmarks GROUP BY ALL UNION ALL SELECT case_id, count(*), 'timeline_events' FROM case_timeline GROUP BY ALL""",
    "case_posture_summaries": "SELECT case_id, capture_id, posture_state, overall_score, confidence, total_sessions, affected_sessions FROM posture JOIN case_captures USING (capture_id)",
    "remediation_counts": """
SELECT case_id, count(*) FILTER (status IN ('OPEN', 'PLANNED')) AS open, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (status = 'BLOCKED') AS blocked,
  count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (verification_status = 'PENDING') AS verification_pending, count(*) FILTER (verification_status = 'VERIFIED') AS verified,
  count(*) FILTER (verification_status = 'FAILED') AS failed, count(*) FILTER (verification_status = 'INCONCLUSIVE') AS inconclusive FROM remediations GROUP BY case_id""",
    "remediation_by_status": "SELECT case_id, status, count(*) AS n FROM remediations GROUP BY ALL",
    "evidence_manifest": f"""
SELECT k.case_id, k.capture_id, k.idx, c.filename, c.sha256, c.size_bytes, {iso('c.ingested_at')} AS ingested_at, coalesce(a.status, 'not_analyzed') AS status, {iso('a.analyzed_at')} AS analyzed_at
FROM case_captures k JOIN captures c USING (capture_id) LEFT JOIN analysis a USING (capture_id)""",
    "evidence_digest": f"""
WITH hashed AS (
  SELECT case_id, sha256(concat(finding_id, '|', severity, '|', confidence, '|', observed_value)) AS h, count(*) AS copies FROM findings JOIN case_captures USING (capture_id) GROUP BY ALL
), evidence_items AS (SELECT case_id, concat(h, ':', copies) AS item, count(*) OVER (PARTITION BY case_id) AS n FROM hashed)
SELECT case_id, sha256(text) AS evidence_digest FROM ({tree_sql('evidence_items', 'case_id', EVIDENCE_LEAF)})""",
}
