"""Posture as SQL, in the same integer arithmetic but per finding rather than per condition group."""

from __future__ import annotations

from oracle.evidence import CTES, bands_sql, case_sql, half_even, iso, q
from postern.functions import fixed_values as V

W4 = f"({case_sql('severity', V.SEVERITY_WEIGHTS, '0')} * {case_sql('confidence', V.CONFIDENCE_QUARTERS, '1')})"
SEV_RANK = case_sql("severity", V.SEVERITY_RANKS, "-1")
RANK_SEV = lambda r: case_sql(r, {v: k for k, v in V.SEVERITY_RANKS.items()})
STATUS = lambda r: case_sql(r, {V.SEVERITY_RANKS[s]: t for s, t in V.FACTOR_STATUS_BY_SEVERITY.items()}, "'ok'")

CTES["session_totals"] = """
SELECT capture_id, count(*) AS total_sessions, count(DISTINCT server_ip) AS total_hosts FROM sessions GROUP BY capture_id"""
CTES["prevalence"] = """
SELECT capture_id, rule_id, observed_value, count(DISTINCT session_id) AS affected_sessions FROM findings GROUP BY ALL"""
CTES["deductions"] = f"""
SELECT f.*, p.affected_sessions, t.total_sessions, {case_sql('rule_id', V.FACTOR_BY_RULE, "'other'")} AS factor,
  {half_even(f'{W4} * (total_sessions + least(affected_sessions, total_sessions)) * 100', 'total_sessions * 8')} AS deduction_cents
FROM findings f JOIN prevalence p USING (capture_id, rule_id, observed_value) JOIN session_totals t USING (capture_id)"""
_labels = ", ".join(f"({q(k)}, {q(v)})" for k, v in V.FACTOR_LABELS.items())
CTES["posture_factors_t"] = f"""
SELECT t.capture_id, l.factor, l.label, t.total_sessions, {STATUS('worst')} AS status,
  coalesce({half_even('highest * 3 + total', '4')}, 0) AS contribution_cents,
  coalesce(affected_sessions, 0) AS affected_sessions, coalesce(affected_hosts, 0) AS affected_hosts,
  coalesce(conditions, 0) AS conditions,
  CASE WHEN conditions IS NULL THEN 'No findings in this domain.' ELSE
    concat('Dominated by ''', dominating, ''' (', CAST(conditions AS VARCHAR), ' condition(s) correlated in this domain).') END AS explanation
FROM session_totals t CROSS JOIN (VALUES {_labels}) l(factor, label)
LEFT JOIN (SELECT capture_id, factor, max(deduction_cents) AS highest, CAST(sum(deduction_cents) AS BIGINT) AS total,
    count(*) AS conditions, count(DISTINCT session_id) AS affected_sessions, count(DISTINCT server_ip) AS affected_hosts,
    max({SEV_RANK}) AS worst, arg_min(title, (-deduction_cents, finding_id)) AS dominating
  FROM deductions GROUP BY ALL) g ON g.capture_id = t.capture_id AND g.factor = l.factor"""
CTES["posture_scores"] = f"""
SELECT capture_id, least(10000, total) AS deduction_cents, score AS overall_score, {bands_sql('score', V.POSTURE_BANDS, V.LOWEST_POSTURE_BAND)} AS posture_state
FROM (SELECT capture_id, total, {half_even('10000 - least(10000, total)', '100')} AS score
  FROM (SELECT capture_id, CAST(sum(contribution_cents) AS BIGINT) AS total FROM posture_factors_t GROUP BY capture_id))"""
CTES["posture_confidences"] = f"""
SELECT t.capture_id, coalesce(c.confidence, 'high') AS confidence FROM session_totals t LEFT JOIN (
  SELECT capture_id, {case_sql('min(r)', {v: k for k, v in V.CONFIDENCE_RANKS.items()}, "'unknown'")} AS confidence FROM (
    SELECT capture_id, {case_sql('confidence', V.CONFIDENCE_RANKS, '0')} AS r,
      row_number() OVER (PARTITION BY capture_id ORDER BY deduction_cents DESC, finding_id) AS n
    FROM deductions WHERE deduction_cents > 0) WHERE n <= 3 GROUP BY capture_id) c USING (capture_id)"""
CTES["posture_priorities_t"] = f"""
SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY priority_cents DESC, rule_id) AS BIGINT) AS position, *
  EXCLUDE (capture_id, dom),
  concat(severity, ' severity affecting ', CAST(affected_sessions AS VARCHAR), '/', CAST(total_sessions AS VARCHAR), ' session(s) (',
    CAST({half_even('prevalence_e4', '100')} AS VARCHAR), '% prevalence) across ', CAST(affected_hosts AS VARCHAR),
    ' host(s) with ', confidence, ' evidence confidence') AS explanation
FROM (SELECT *, {half_even(f'{W4} * (10000 + prevalence_e4)', '800')} AS priority_cents FROM (
  SELECT *, dom.severity AS severity, dom.confidence AS confidence, dom.title AS title,
    {half_even('least(affected_sessions, total_sessions) * 10000', 'total_sessions')} AS prevalence_e4 FROM (
    SELECT capture_id, rule_id, total_sessions, count(DISTINCT session_id) AS affected_sessions,
      count(DISTINCT server_ip) AS affected_hosts, CAST(sum(n_refs) AS BIGINT) AS evidence_count, count(*) AS findings,
      arg_min({{'severity': severity, 'confidence': confidence, 'title': title}}, (-deduction_cents, finding_id)) AS dom
    FROM deductions GROUP BY capture_id, rule_id, total_sessions)))"""
CTES["evidence_times"] = """
SELECT capture_id, max(seen_at) AS generated_at FROM (SELECT capture_id, detected_at AS seen_at FROM findings UNION ALL
  SELECT capture_id, ended_at FROM sessions) GROUP BY capture_id"""
CTES["posture"] = f"""
SELECT c.capture_id, 'baseline' AS policy_id, '1.0' AS policy_version, coalesce(s.posture_state, 'insufficient_evidence') AS posture_state,
  s.overall_score, coalesce(k.confidence, 'low') AS confidence, coalesce(t.total_sessions, 0) AS total_sessions,
  coalesce(a.affected_sessions, 0) AS affected_sessions, coalesce(a.affected_hosts, 0) AS affected_hosts,
  coalesce(t.total_hosts, 0) AS total_hosts, {iso('e.generated_at')} AS generated_at
FROM captures c LEFT JOIN session_totals t USING (capture_id) LEFT JOIN posture_scores s USING (capture_id)
LEFT JOIN posture_confidences k USING (capture_id) LEFT JOIN evidence_times e USING (capture_id)
LEFT JOIN (SELECT capture_id, count(DISTINCT session_id) AS affected_sessions, count(DISTINCT server_ip) AS affected_hosts
  FROM findings GROUP BY capture_id) a USING (capture_id)"""
POINTS = (
    "CASE WHEN contribution_cents % 100 = 0 THEN CAST(contribution_cents // 100 AS VARCHAR) "
    "WHEN contribution_cents % 10 = 0 THEN concat(CAST(contribution_cents // 100 AS VARCHAR), '.', CAST(contribution_cents % 100 // 10 AS VARCHAR)) "
    "ELSE concat(CAST(contribution_cents // 100 AS VARCHAR), '.', lpad(CAST(contribution_cents % 100 AS VARCHAR), 2, '0')) END"
)
LISTED = lambda c: f"array_to_string(list_sort(list_distinct(list({c}))), ', ')"

CTES["posture_hosts_t"] = f"""
SELECT s.capture_id, concat('host_', substr(sha256(s.server_ip), 1, 12)) AS host_id, s.server_ip AS ip, s.sessions, s.protocols,
  coalesce(f.n, 0) AS findings_count, {RANK_SEV('f.worst')} AS highest_severity, f.n IS NOT NULL AS affected, s.tls_versions
FROM (SELECT capture_id, server_ip, count(*) AS sessions, coalesce({LISTED('protocol')}, '') AS protocols,
    coalesce(array_to_string(list_sort(list_distinct(list(tls_version) FILTER (has_handshake))), ', '), '') AS tls_versions FROM sessions GROUP BY ALL) s
LEFT JOIN (SELECT capture_id, server_ip, count(*) AS n, max({SEV_RANK}) AS worst FROM findings GROUP BY ALL) f USING (capture_id, server_ip)"""
CTES["posture_protocols_t"] = f"""
SELECT s.capture_id, s.protocol, s.sessions, coalesce(f.n, 0) AS findings, coalesce(f.a, 0) AS affected_sessions, {STATUS('f.worst')} AS status
FROM (SELECT capture_id, protocol, count(*) AS sessions FROM sessions WHERE protocol IS NOT NULL GROUP BY ALL) s
LEFT JOIN (SELECT capture_id, protocol, count(*) AS n, count(DISTINCT session_id) AS a, max({SEV_RANK}) AS worst FROM findings GROUP BY ALL) f
USING (capture_id, protocol)"""

BODIES = {
    "condition_prevalence": "SELECT * FROM prevalence",
    "finding_deduction": """SELECT finding_id, capture_id, rule_id, observed_value, affected_sessions, total_sessions, deduction_cents,
      factor, deduction_cents / 100 AS deduction FROM deductions""",
    "posture_factors": "SELECT *, contribution_cents / 100 AS score_contribution FROM posture_factors_t",
    "posture_factor_findings": "SELECT capture_id, factor, deduction_cents, finding_id FROM deductions WHERE factor <> 'other'",
    "posture_score": "SELECT * FROM posture_scores",
    "posture_score_from_stored_findings": "SELECT * FROM posture_scores",
    "posture_confidence": "SELECT * FROM posture_confidences",
    "posture_hosts": "SELECT * FROM posture_hosts_t",
    "posture_protocols": "SELECT * FROM posture_protocols_t",
    "posture_priorities": "SELECT *, prevalence_e4 / 10000 AS prevalence, priority_cents / 100 AS priority_score FROM posture_priorities_t",
    "posture_explanation": f"""
SELECT capture_id, coalesce(lines, 'No policy violations observed in the analyzed sessions.') AS explanation
FROM session_totals LEFT JOIN (SELECT capture_id, string_agg(line, chr(10) ORDER BY part, n1, n2) AS lines FROM (
  SELECT capture_id, 0 AS part, -contribution_cents AS n1, factor AS n2, concat(label, ': ', status, ' — ', CAST(affected_sessions AS VARCHAR), '/',
    CAST(total_sessions AS VARCHAR), ' session(s) affected (-', {POINTS}, ' points)') AS line FROM posture_factors_t WHERE contribution_cents > 0
  UNION ALL SELECT capture_id, 1, position, '', concat('Priority ', CAST(position AS VARCHAR), ': ', title, ' (', explanation, ')')
  FROM posture_priorities_t WHERE position <= 3) GROUP BY capture_id) USING (capture_id)""",
    "posture_snapshot": "SELECT * FROM posture",
    "severity_counts": "SELECT capture_id, severity, count(*) AS findings FROM findings GROUP BY ALL",
    "category_counts": "SELECT capture_id, category, count(*) AS findings FROM findings GROUP BY ALL",
    "evidence_time": f"SELECT capture_id, {iso('generated_at')} AS generated_at FROM evidence_times",
    "rule_max_severity": f"SELECT capture_id, rule_id, {RANK_SEV(f'max({SEV_RANK})')} AS severity FROM findings GROUP BY ALL",
}
