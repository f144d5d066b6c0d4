"""Observations, lifecycle, drift and verification as SQL, pair by pair."""

from __future__ import annotations

from oracle.evidence import CTES, case_sql, q, sha
from oracle.posture_sql import RANK_SEV, SEV_RANK
from postern.functions import fixed_values as V

WORDS = lambda c: f"array_to_string(list_sort(list_distinct(list({c}))), ',')"
EP = "concat(protocol, '|', server_ip, '|', CAST(server_port AS VARCHAR))"
CTES["chain"] = """
SELECT case_id, capture_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY idx) - 1 AS BIGINT) AS pos
FROM case_captures WHERE capture_id IN (SELECT capture_id FROM analysis WHERE status = 'completed')"""
CTES["pairs"] = """
SELECT l.case_id, p.capture_id AS previous_capture_id, l.capture_id AS later_capture_id, l.pos AS later_pos,
  coalesce(b.baseline_capture_id, p.capture_id) AS anchor_capture_id, coalesce(bc.pos, l.pos - 1) AS anchor_pos
FROM chain l JOIN chain p ON p.case_id = l.case_id AND p.pos = l.pos - 1 LEFT JOIN baselines b ON b.case_id = l.case_id
LEFT JOIN chain bc ON bc.case_id = l.case_id AND bc.capture_id = b.baseline_capture_id"""
CTES["rule_presence"] = f"""
SELECT capture_id, rule_id, {RANK_SEV(f'max({SEV_RANK})')} AS severity, min(title) AS title, count(*) AS n, min(finding_id) AS first_finding_id
FROM findings GROUP BY capture_id, rule_id"""
TLSCFG = sha("tlscfg_", "concat(tls_version, '|', cipher_suite, '|', key_exchange)", 12)
CTES["tls_presence"] = f"""
SELECT DISTINCT capture_id, {TLSCFG} AS fingerprint, tls_version, cipher_suite, key_exchange FROM sessions WHERE has_handshake"""
CTES["cert_presence"] = """
SELECT capture_id, fingerprint_sha256 AS fingerprint, any_value(subject) AS subject, any_value(issuer) AS issuer, count(*) AS sessions,
  min(started_at) BETWEEN any_value(not_before) AND any_value(not_after) AS valid FROM certificates GROUP BY capture_id, fingerprint_sha256"""
CTES["band_text"] = """
SELECT capture_id, concat(string_agg(concat(status, '=', CAST(n AS VARCHAR)), ';' ORDER BY status), ';total_evaluated=', CAST(CAST(sum(scored) AS BIGINT) AS VARCHAR),
  ';total_sessions=', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR)) AS bands
FROM (SELECT capture_id, status, count(*) AS n, count(score) AS scored FROM anomalies GROUP BY ALL) GROUP BY capture_id"""
CTES["observations"] = f"""
SELECT concat('obs_', substr(sha256(concat(case_id, '|', capture_id, '|', evidence_digest)), 1, 16)) AS observation_id, * FROM (
SELECT c.case_id, c.capture_id, c.pos, p.posture_state, p.overall_score AS posture_score, s.session_count, r.rules, s.protocols, t.tls_configs, k.certificates, b.bands,
  sha256(concat(coalesce(r.rules, ''), '#', p.posture_state, '#', coalesce(CAST(p.overall_score AS VARCHAR), ''), '#', CAST(s.session_count AS VARCHAR), '#', s.protocols, '#', t.tls_configs, '#',
    coalesce(k.certificates, ''), '#', b.bands)) AS evidence_digest
FROM chain c JOIN (SELECT capture_id, count(*) AS session_count, {WORDS('protocol')} AS protocols FROM sessions GROUP BY ALL) s USING (capture_id)
LEFT JOIN (SELECT capture_id, {WORDS("concat(rule_id, ':', severity, ':', CAST(n AS VARCHAR))")} AS rules FROM rule_presence GROUP BY ALL) r USING (capture_id)
LEFT JOIN (SELECT capture_id, {WORDS('fingerprint')} AS tls_configs FROM tls_presence GROUP BY ALL) t USING (capture_id)
LEFT JOIN (SELECT capture_id, {WORDS('fingerprint')} AS certificates FROM cert_presence GROUP BY ALL) k USING (capture_id)
LEFT JOIN band_text b USING (capture_id) LEFT JOIN posture p USING (capture_id))"""
CTES["rule_endpoints"] = f"SELECT DISTINCT capture_id, rule_id, {EP} AS endpoint FROM findings"
CTES["capture_endpoints"] = f"SELECT DISTINCT capture_id, {EP} AS endpoint FROM sessions"
COMPARABLE = lambda anchor, rule, seen: (
    f"(NOT EXISTS (SELECT 1 FROM rule_presence x WHERE x.capture_id = {anchor} AND x.rule_id = {rule}) OR EXISTS ("
    f"SELECT 1 FROM rule_endpoints re JOIN capture_endpoints ce ON ce.endpoint = re.endpoint WHERE re.capture_id = {anchor} AND re.rule_id = {rule} AND ce.capture_id = {seen}))"
)


def lifecycle_sql(pairs: str) -> str:
    return f"""
SELECT case_id, anchor_capture_id, previous_capture_id, later_capture_id, anchor_pos, later_pos, rule_id, coalesce(a_title, l_title) AS title,
  a_n IS NOT NULL AS baseline_present, l_n IS NOT NULL AS current_present,
  CASE WHEN NOT comparable THEN 'not_comparable' WHEN l_n IS NOT NULL AND gap THEN 'recurred' WHEN l_n IS NOT NULL AND a_n IS NULL THEN 'new' WHEN l_n IS NOT NULL THEN 'persistent'
    WHEN a_n IS NOT NULL OR between_present THEN 'resolved' ELSE 'not_comparable' END AS lifecycle,
  coalesce(a_severity, l_severity) AS severity, a_id AS baseline_finding_id, l_id AS latest_finding_id, comparable, a_severity, l_severity,
  coalesce(a_n, 0) AS baseline_count, coalesce(l_n, 0) AS current_count, absent_in
FROM (SELECT k.*, a.severity AS a_severity, a.title AS a_title, a.n AS a_n, a.first_finding_id AS a_id, l.severity AS l_severity, l.title AS l_title, l.n AS l_n, l.first_finding_id AS l_id,
    {COMPARABLE('k.anchor_capture_id', 'k.rule_id', 'k.later_capture_id')} AS comparable,
    coalesce(g.between_present, FALSE) AS between_present, coalesce(g.gap, FALSE) AS gap, g.absent_in
  FROM (SELECT DISTINCT p.*, r.rule_id FROM ({pairs}) p JOIN rule_presence r ON r.capture_id IN (p.anchor_capture_id, p.later_capture_id)) k
  LEFT JOIN rule_presence a ON a.capture_id = k.anchor_capture_id AND a.rule_id = k.rule_id
  LEFT JOIN rule_presence l ON l.capture_id = k.later_capture_id AND l.rule_id = k.rule_id
  LEFT JOIN (SELECT case_id, anchor_capture_id, later_capture_id, rule_id, bool_or(present) AS between_present, bool_or(NOT present AND comparable AND seen) AS gap,
      string_agg(capture_id, ', ' ORDER BY capture_id) FILTER (NOT present AND comparable) AS absent_in FROM (
    SELECT p.case_id, p.anchor_capture_id, p.later_capture_id, u.rule_id, c.capture_id, m.rule_id IS NOT NULL AS present,
      {COMPARABLE('p.anchor_capture_id', 'u.rule_id', 'c.capture_id')} AS comparable,
      EXISTS (SELECT 1 FROM rule_presence e JOIN chain ec ON ec.capture_id = e.capture_id WHERE ec.case_id = p.case_id AND e.rule_id = u.rule_id AND ec.pos >= p.anchor_pos AND ec.pos < c.pos) AS seen
    FROM (SELECT DISTINCT case_id, anchor_capture_id, anchor_pos, later_capture_id, later_pos FROM ({pairs})) p JOIN chain c ON c.case_id = p.case_id AND c.pos > p.anchor_pos AND c.pos < p.later_pos
    CROSS JOIN (SELECT DISTINCT rule_id FROM rule_presence) u LEFT JOIN rule_presence m ON m.capture_id = c.capture_id AND m.rule_id = u.rule_id)
    GROUP BY ALL) g ON g.case_id = k.case_id AND g.anchor_capture_id = k.anchor_capture_id AND g.later_capture_id = k.later_capture_id AND g.rule_id = k.rule_id)"""


CTES["lifecycle"] = lifecycle_sql("SELECT * FROM pairs")
CTES["compare_requests"] = """
SELECT c.case_id, f.capture_id AS baseline, c.capture_id AS comparison, NULL AS anchor FROM case_captures c JOIN case_captures f ON f.case_id = c.case_id AND f.idx = 0
UNION ALL SELECT f.case_id, (SELECT max_by(x.capture_id, x.idx) FROM case_captures x WHERE x.case_id = f.case_id), f.capture_id, NULL FROM case_captures f WHERE f.idx = 0
UNION ALL SELECT case_id, NULL, capture_id, NULL FROM case_captures
UNION ALL SELECT c.case_id, b.capture_id, c.capture_id, a.capture_id FROM case_captures c JOIN case_captures b ON b.case_id = c.case_id AND b.idx = c.idx - 2 JOIN case_captures a ON a.case_id = c.case_id AND a.idx = 1"""
CTES["requested_pairs"] = """
SELECT DISTINCT case_id, baseline AS previous_capture_id, comparison AS later_capture_id, later_pos, CASE WHEN own THEN baseline ELSE anchor END AS anchor_capture_id,
  CASE WHEN own THEN base_pos ELSE anchor_pos END AS anchor_pos,
  CASE WHEN baseline IS NULL THEN 'no baseline selected' WHEN baseline = comparison THEN 'captures are the same' WHEN base_pos IS NULL THEN 'baseline capture has not been analysed'
    WHEN later_pos IS NULL THEN 'comparison capture has not been analysed' WHEN NOT own AND anchor_pos IS NULL THEN 'anchor capture has not been analysed' END AS problem
FROM (SELECT r.*, bc.pos AS base_pos, cc.pos AS later_pos, ac.pos AS anchor_pos, ai.idx > ci.idx AS own
  FROM (SELECT q.case_id, coalesce(q.baseline, b.baseline_capture_id) AS baseline, comparison, coalesce(anchor, b.baseline_capture_id, q.baseline) AS anchor FROM compare_requests q LEFT JOIN baselines b USING (case_id)) r
  LEFT JOIN chain bc ON bc.case_id = r.case_id AND bc.capture_id = r.baseline LEFT JOIN chain cc ON cc.case_id = r.case_id AND cc.capture_id = r.comparison
  LEFT JOIN chain ac ON ac.case_id = r.case_id AND ac.capture_id = r.anchor LEFT JOIN case_captures ci ON ci.case_id = r.case_id AND ci.capture_id = r.comparison
  LEFT JOIN case_captures ai ON ai.case_id = r.case_id AND ai.capture_id = r.anchor)"""
CTES["explicit_pairs"] = "SELECT * EXCLUDE (problem) FROM requested_pairs WHERE problem IS NULL"
CTES["explicit_lifecycle"] = lifecycle_sql("SELECT * FROM explicit_pairs")
LAST = """SELECT p.case_id, p.previous_capture_id, p.later_capture_id, p.later_pos, f.capture_id AS anchor_capture_id, CAST(0 AS BIGINT) AS anchor_pos FROM pairs p
  JOIN chain f ON f.case_id = p.case_id AND f.pos = 0 WHERE p.later_pos = (SELECT max(x.pos) FROM chain x WHERE x.case_id = p.case_id)"""


def record(kind: str, key: str, before: str, after: str, statement: str, source: str) -> str:
    identity = sha("drift_", f"concat(case_id, '|', anchor_capture_id, '|', later_capture_id, '|', {kind}, '|', {key})", 16)
    return (
        f"SELECT {identity} AS drift_id, case_id, {kind} AS drift_type, {key} AS evidence_key, anchor_capture_id AS baseline_capture_id, previous_capture_id, "
        f"later_capture_id AS comparison_capture_id, {before} AS before_value, {after} AS after_value, {statement} AS statement FROM ({source})"
    )


def posture_records(pairs: str) -> str:
    b = "concat(ps, ':', coalesce(CAST(pv AS VARCHAR), 'None'))"
    a = "concat(ls, ':', coalesce(CAST(lv AS VARCHAR), 'None'))"
    return record(
        "'posture_change'", f"concat('posture|', {b}, '->', {a})", b, a,
        "concat_ws(' ', CASE WHEN ps <> ls THEN concat('Posture state changed from ', ps, ' to ', ls, '.') END, "
        "CASE WHEN pv <> lv THEN concat('Posture score changed from ', CAST(pv AS VARCHAR), ' to ', CAST(lv AS VARCHAR), '.') END)",
        f"SELECT p.*, a.posture_state AS ps, a.overall_score AS pv, b.posture_state AS ls, b.overall_score AS lv FROM ({pairs}) p JOIN posture a ON a.capture_id = previous_capture_id "
        "JOIN posture b ON b.capture_id = later_capture_id WHERE a.posture_state <> b.posture_state OR coalesce(a.overall_score <> b.overall_score, FALSE)",
    )


def finding_records(lifecycle: str) -> str:
    return record(
        "CASE lifecycle WHEN 'new' THEN 'finding_introduced' WHEN 'resolved' THEN 'finding_resolved' ELSE 'finding_recurred' END", "concat('finding-rule|', lower(rule_id))",
        "CASE WHEN lifecycle = 'new' THEN 'absent' ELSE concat('present:', coalesce(a_severity, 'none'), ':', CAST(baseline_count AS VARCHAR)) END",
        "CASE WHEN lifecycle = 'resolved' THEN 'absent' ELSE concat('present:', coalesce(l_severity, 'none'), ':', CAST(current_count AS VARCHAR)) END",
        "CASE lifecycle WHEN 'new' THEN concat('Rule ', rule_id, ' was first observed in capture ', later_capture_id, ' (absent from baseline capture ', anchor_capture_id, ').') "
        "WHEN 'resolved' THEN concat('Rule ', rule_id, ' observed in baseline capture ', anchor_capture_id, ' was not observed in capture ', later_capture_id, '.') "
        "ELSE concat('Rule ', rule_id, ' was observed again in capture ', later_capture_id, ' after being absent in ', coalesce(absent_in, 'an intermediate observation'), '.') END",
        f"SELECT * FROM {lifecycle} WHERE lifecycle IN ('new', 'resolved', 'recurred')",
    )


def diff(presence: str, keys: str, columns: str, pairs: str = "pairs") -> str:
    on = " AND ".join(f"l.{k} = e.{k}" for k in keys.split(", "))
    both = f"""SELECT p.case_id, p.previous_capture_id, p.later_capture_id, p.later_pos, p.anchor_capture_id, {{cols}}, {{flag}} AS in_later
  FROM {pairs} p JOIN {presence} {{a}} ON {{a}}.capture_id = p.{{mine}} LEFT JOIN {presence} {{b}} ON {{b}}.capture_id = p.{{other}} AND {on} WHERE {{b}}.capture_id IS NULL"""
    cols = lambda a: ", ".join(f"{a}.{c}" for c in columns.split(", "))
    return (
        both.format(cols=cols("e"), flag="FALSE", a="e", b="l", mine="previous_capture_id", other="later_capture_id") + " UNION ALL "
        + both.format(cols=cols("l"), flag="TRUE", a="l", b="e", mine="later_capture_id", other="previous_capture_id")
    )


def appeared(name: str, entity: str) -> str:
    return (
        f"concat('{name}', {entity}, ' was observed in capture ', CASE WHEN in_later THEN later_capture_id ELSE previous_capture_id END, ' but not in capture ', "
        "CASE WHEN in_later THEN previous_capture_id ELSE later_capture_id END, '.')"
    )


def presence_record(kind, prefix, entity, detail, name, source):
    return record(
        q(kind), f"concat('{prefix}', {entity})", f"CASE WHEN in_later THEN 'absent' ELSE {detail} END", f"CASE WHEN in_later THEN {detail} ELSE 'absent' END", appeared(name, entity), source
    )


CTES["protocol_presence"] = "SELECT DISTINCT capture_id, protocol FROM sessions"
def parts(pairs: str, lifecycle: str) -> dict[str, str]:
    return {
        "drift_posture": posture_records(f"SELECT * FROM {pairs}"),
        "drift_findings": finding_records(lifecycle),
        "drift_tls_config": presence_record(
            "tls_configuration_changed", "tls-config|", "fingerprint", "concat('present|', tls_version, '|', cipher_suite, '|', key_exchange)", "TLS configuration ",
            diff("tls_presence", "fingerprint", "fingerprint, tls_version, cipher_suite, key_exchange", pairs),
        ),
        "drift_certificate": presence_record(
            "certificate_changed", "certificate|", "fingerprint", "concat('present|', subject, '|', issuer)", "Certificate ", diff("cert_presence", "fingerprint", "fingerprint, subject, issuer", pairs)
        ),
        "drift_certificate_validity": record(
            "'certificate_validity_changed'", "concat('certificate-validity|', fingerprint)", "concat('valid=', CAST(was AS VARCHAR))", "concat('valid=', CAST(now AS VARCHAR))",
            "concat('Certificate ', fingerprint, ' validity status changed between capture ', previous_capture_id, ' and capture ', later_capture_id, '.')",
            f"SELECT p.*, a.fingerprint, a.valid AS was, b.valid AS now FROM {pairs} p JOIN cert_presence a ON a.capture_id = previous_capture_id JOIN cert_presence b ON b.capture_id = later_capture_id AND b.fingerprint = a.fingerprint WHERE a.valid <> b.valid",
        ),
        "drift_protocol": presence_record("protocol_behavior_changed", "protocol|", "protocol", "'present'", "Protocol ", diff("protocol_presence", "protocol", "protocol", pairs)),
        "drift_anomaly_bands": record(
            "'anomaly_state_changed'", "'anomaly-bands'", "was", "now", "concat('Anomaly band distribution changed between capture ', previous_capture_id, ' and capture ', later_capture_id, '.')",
            f"SELECT p.*, a.bands AS was, b.bands AS now FROM {pairs} p JOIN band_text a ON a.capture_id = previous_capture_id JOIN band_text b ON b.capture_id = later_capture_id WHERE a.bands <> b.bands",
        ),
        "drift_correlation": record(
            "'correlation_pattern_changed'", "concat('correlation|', correlation_type, '|', evidence_key)", "CAST(NOT in_later AS VARCHAR)", "CAST(in_later AS VARCHAR)",
            "concat('Shared evidence ', correlation_type, ' (', evidence_key, ') is ', CASE WHEN in_later THEN 'observed' ELSE 'no longer observed' END, ' in capture ', CASE WHEN in_later THEN later_capture_id ELSE previous_capture_id END, '.')",
            diff("corr_captures", "case_id, correlation_type, evidence_key", "correlation_type, evidence_key", pairs).replace(
                "ON e.capture_id = p.previous_capture_id LEFT", "ON e.capture_id = p.previous_capture_id AND e.case_id = p.case_id LEFT"
            ).replace("ON l.capture_id = p.later_capture_id LEFT", "ON l.capture_id = p.later_capture_id AND l.case_id = p.case_id LEFT"),
        ),
    }


PARTS = parts("pairs", "lifecycle")
CTES["drift_records"] = " UNION ALL ".join(PARTS.values())
CTES["requests"] = """
SELECT r.case_id, r.remediation_id, r.target_id AS finding_id, c.capture_id AS target_capture_id FROM remediations r JOIN chain c ON c.case_id = r.case_id AND c.pos > 0"""
CTES["verified"] = """
SELECT *, CASE WHEN session_match = 'no_matching_session' THEN 'inconclusive' WHEN rule_present THEN 'failed' ELSE 'verified' END AS outcome,
  CASE WHEN session_match = 'no_matching_session' THEN concat('Rule ', rule_id, ' could not be verified: verification capture ', target_capture_id, ' does not contain the relevant session.')
    WHEN rule_present THEN concat('Rule ', rule_id, ' was still observed in verification capture ', target_capture_id, ' for the relevant session.')
    ELSE concat('Rule ', rule_id, ' was not observed in verification capture ', target_capture_id, ' for the relevant session.') END AS statement FROM (
  SELECT q.case_id, q.remediation_id, q.finding_id, q.target_capture_id, f.rule_id, f.capture_id AS baseline_capture_id, f.session_id AS baseline_session_id,
    CASE WHEN m.sid IS NULL THEN 'no_matching_session' ELSE 'matched' END AS session_match, m.sid AS verification_session_id,
    CASE WHEN m.sid IS NOT NULL THEN EXISTS (SELECT 1 FROM findings g WHERE g.capture_id = q.target_capture_id AND g.rule_id = f.rule_id AND g.protocol = f.protocol AND g.server_ip = f.server_ip AND g.server_port = f.server_port) END AS rule_present,
    pa.overall_score - pb.overall_score AS posture_delta_points
  FROM requests q JOIN findings f USING (finding_id) LEFT JOIN (SELECT capture_id, protocol, server_ip, server_port, min(session_id) AS sid FROM sessions GROUP BY ALL) m
    ON m.capture_id = q.target_capture_id AND m.protocol = f.protocol AND m.server_ip = f.server_ip AND m.server_port = f.server_port
  LEFT JOIN posture pb ON pb.capture_id = f.capture_id LEFT JOIN posture pa ON pa.capture_id = q.target_capture_id)"""
CTES["verifications"] = "SELECT concat('verif_', substr(sha256(concat(remediation_id, '|', target_capture_id)), 1, 16)) AS verification_id, *, upper(outcome) AS result FROM verified"
CTES["regressions"] = """
SELECT drift_id, case_id, evidence_key, comparison_capture_id, concat(statement, ' Existing remediation ', remediation_ids, ' may require review.') AS statement, remediation_ids, verification_ids FROM (
  SELECT d.drift_id, d.case_id, d.evidence_key, d.comparison_capture_id, d.statement, array_to_string(list_sort(list_distinct(list(r.remediation_id))), ', ') AS remediation_ids,
    array_to_string(list_sort(list_distinct(list(v.verification_id))), ', ') AS verification_ids
  FROM drift_records d JOIN remediations r ON r.case_id = d.case_id AND lower(r.rule_id) = substr(d.evidence_key, 14) JOIN verifications v ON v.remediation_id = r.remediation_id AND v.result = 'VERIFIED'
  WHERE d.drift_type = 'finding_recurred' GROUP BY ALL)"""
_paths = "CASE o_orderkey % 4 WHEN 0 THEN ['OPEN', 'PLANNED', 'IN_PROGRESS', 'COMPLETED'] WHEN 1 THEN ['OPEN', 'COMPLETED', 'OPEN'] WHEN 2 THEN ['OPEN', 'PLANNED', 'IN_PROGRESS', 'BLOCKED', 'COMPLETED'] ELSE ['OPEN', 'CANCELLED'] END"
CTES["status_timeline"] = f"""
SELECT remediation_id, CAST(i - 1 AS BIGINT) AS entry_seq, statuses[i] AS status FROM (SELECT concat('rem_', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS remediation_id, statuses,
  unnest(generate_series(1, len(statuses))) AS i FROM (SELECT o_orderkey, {_paths} AS statuses FROM orders))"""
LC = """case_id, anchor_capture_id, previous_capture_id, later_capture_id, rule_id, title, baseline_present, current_present, lifecycle, severity, baseline_finding_id, latest_finding_id, comparable"""
ORDER = "drift_type, evidence_key, baseline_capture_id, comparison_capture_id, drift_id"
_sides = lambda suffix, capture: ", ".join(f"{suffix}.{c} AS {c}_{'before' if suffix == 'b' else 'after'}" for c in ("score", "tls_version", "cipher_suite", "key_exchange", "configurations", "certificates", "protocols"))

BODIES = {
    "observation_build": "SELECT * FROM observations",
    "observation_rules": "SELECT * FROM rule_presence",
    "observation_certificates": "SELECT * FROM cert_presence",
    "bounded_refs": "SELECT * FROM (SELECT capture_id, rule_id, finding_id, row_number() OVER (PARTITION BY capture_id, rule_id ORDER BY finding_id) AS position FROM findings) WHERE position <= 200",
    "join_pairwise_observations": "SELECT * FROM pairs",
    "join_intermediates": "SELECT p.case_id, p.anchor_capture_id, p.later_capture_id, c.capture_id AS between_capture_id FROM pairs p JOIN chain c ON c.case_id = p.case_id AND c.pos > p.anchor_pos AND c.pos < p.later_pos",
    "posture_trend": """
SELECT case_id, capture_id, pos, posture_state, overall_score, overall_score - last_value(overall_score IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS score_change_points
FROM chain LEFT JOIN posture USING (capture_id)""",
    "comparable": f"""
SELECT c.case_id, f.capture_id AS anchor_capture_id, c.capture_id AS observed_capture_id, r.rule_id, {COMPARABLE('f.capture_id', 'r.rule_id', 'c.capture_id')} AS comparable
FROM chain c JOIN chain f ON f.case_id = c.case_id AND f.pos = 0 CROSS JOIN (SELECT DISTINCT rule_id FROM findings) r""",
    "endpoint_intersection": """
SELECT DISTINCT p.case_id, p.later_capture_id, a.endpoint FROM pairs p JOIN capture_endpoints a ON a.capture_id = p.previous_capture_id JOIN capture_endpoints b ON b.capture_id = p.later_capture_id AND b.endpoint = a.endpoint""",
    "presence_except": f"""
SELECT case_id, later_capture_id, protocol AS entity, CASE WHEN in_later THEN 'new' ELSE 'gone' END AS change FROM ({diff('protocol_presence', 'protocol', 'protocol')})
UNION ALL SELECT case_id, later_capture_id, fingerprint, CASE WHEN in_later THEN 'new' ELSE 'gone' END FROM ({diff('cert_presence', 'fingerprint', 'fingerprint')})""",
    "join_presence_diff": f"SELECT case_id, fingerprint, later_pos, in_later FROM ({diff('tls_presence', 'fingerprint', 'fingerprint')})",
    "rule_union_keys": "SELECT DISTINCT p.case_id, p.later_capture_id, r.rule_id FROM pairs p JOIN rule_presence r ON r.capture_id IN (p.anchor_capture_id, p.later_capture_id)",
    "finding_lifecycle": f"SELECT {LC} FROM lifecycle",
    "lifecycle_at": f"SELECT {LC} FROM ({lifecycle_sql(LAST)})",
    **PARTS,
    "drift_chain": "SELECT * FROM drift_records",
    "drift_id": "SELECT drift_id, case_id, drift_type FROM drift_records",
    "drift_list": f"SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {ORDER}) AS position, drift_id, drift_type, evidence_key FROM drift_records) WHERE position <= 1000",
    "drift_summary": f"""
SELECT c.case_id, coalesce(o.n, 0) AS observations, b.baseline_capture_id, coalesce(d.drift_count, 0) AS drift_count, coalesce(d.posture_changes, 0) AS posture_changes, coalesce(d.new_findings, 0) AS new_findings,
  coalesce(d.resolved_findings, 0) AS resolved_findings, coalesce(d.recurring_findings, 0) AS recurring_findings, coalesce(d.configuration_changes, 0) AS configuration_changes, coalesce(d.anomaly_changes, 0) AS anomaly_changes
FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM chain GROUP BY ALL) o USING (case_id) LEFT JOIN baselines b USING (case_id) LEFT JOIN (
  SELECT case_id, count(*) AS drift_count, count(*) FILTER (drift_type = 'posture_change') AS posture_changes, count(*) FILTER (drift_type = 'finding_introduced') AS new_findings,
    count(*) FILTER (drift_type = 'finding_resolved') AS resolved_findings, count(*) FILTER (drift_type = 'finding_recurred') AS recurring_findings,
    count(*) FILTER (drift_type IN {V.CONFIGURATION_DRIFT_TYPES}) AS configuration_changes, count(*) FILTER (drift_type = 'anomaly_state_changed') AS anomaly_changes FROM drift_records GROUP BY case_id) d USING (case_id)""",
    "drift_compare_requests": "SELECT * EXCLUDE (later_pos, anchor_pos) FROM requested_pairs",
    "drift_compare_explicit": " UNION ALL ".join(parts("explicit_pairs", "explicit_lifecycle").values()),
    "case_comparisons": f"""
WITH state AS (SELECT p.capture_id, p.overall_score AS score, h.tls_version, h.cipher_suite, h.key_exchange, t.configurations, c.certificates, r.protocols FROM posture p
  LEFT JOIN (SELECT capture_id, {WORDS('tls_version')} AS tls_version, {WORDS('cipher_suite')} AS cipher_suite, {WORDS('key_exchange')} AS key_exchange FROM sessions WHERE has_handshake GROUP BY ALL) h USING (capture_id)
  LEFT JOIN (SELECT capture_id, count(*) AS configurations FROM tls_presence GROUP BY ALL) t USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS certificates FROM cert_presence GROUP BY ALL) c USING (capture_id)
  LEFT JOIN (SELECT capture_id, {WORDS('protocol')} AS protocols FROM sessions GROUP BY ALL) r USING (capture_id))
SELECT p.*, {_sides('b', '')}, {_sides('a', '')}, a.score - b.score AS score_delta, coalesce(d.n, 0) AS drift_records FROM pairs p LEFT JOIN state b ON b.capture_id = p.previous_capture_id LEFT JOIN state a ON a.capture_id = p.later_capture_id
LEFT JOIN (SELECT case_id, comparison_capture_id, count(*) AS n FROM drift_records GROUP BY ALL) d ON d.case_id = p.case_id AND d.comparison_capture_id = p.later_capture_id""",
    "join_regression_links": "SELECT * FROM regressions",
    "drift_regression_view": """
SELECT r.remediation_id, r.case_id, r.rule_id, r.status, l.lifecycle AS current_lifecycle, l.current_present, coalesce(o.n - 1, 0) AS later_observations, coalesce(g.n, 0) AS related_drifts, g.n IS NOT NULL AS regression_detected
FROM remediations r LEFT JOIN (SELECT case_id, rule_id, arg_max(lifecycle, later_pos) AS lifecycle, arg_max(current_present, later_pos) AS current_present FROM lifecycle GROUP BY ALL) l USING (case_id, rule_id)
LEFT JOIN (SELECT case_id, count(*) AS n FROM chain GROUP BY ALL) o USING (case_id) LEFT JOIN (SELECT case_id, substr(evidence_key, 14) AS rule, count(*) AS n FROM regressions GROUP BY ALL) g ON g.case_id = r.case_id AND g.rule = lower(r.rule_id)""",
    "verify_rule": "SELECT * FROM verified",
    "join_candidate_sessions": """
SELECT f.capture_id, c.* FROM (SELECT DISTINCT capture_id, protocol, server_ip, server_port FROM findings) f JOIN (
  SELECT capture_id AS target_capture_id, protocol, server_ip, server_port, min(session_id) AS matched_session_id, count(*) AS candidates FROM sessions GROUP BY ALL) c
ON f.protocol IS NOT DISTINCT FROM c.protocol AND f.server_ip = c.server_ip AND f.server_port = c.server_port""",
    "join_rule_in_candidates": """
SELECT r.case_id, r.remediation_id, r.finding_id, r.target_capture_id, b.rule_id, s.protocol, s.server_ip, s.server_port FROM requests r JOIN findings b USING (finding_id) JOIN sessions s ON s.session_id = b.session_id
WHERE EXISTS (SELECT 1 FROM findings f WHERE f.capture_id = r.target_capture_id AND f.rule_id = b.rule_id AND f.protocol IS NOT DISTINCT FROM s.protocol AND f.server_ip = s.server_ip AND f.server_port = s.server_port)""",
    "verification_eligibility": "SELECT r.remediation_id, r.case_id, c.capture_id AS target_capture_id FROM remediations r JOIN chain c USING (case_id)",
    "verification_by_result": "SELECT case_id, result, count(*) AS n FROM verifications GROUP BY ALL",
    "remediation_from_finding": """
SELECT finding_id, title, rule_id, CASE WHEN action IS NULL THEN '' ELSE concat('Recommended action from policy baseline: ', action, chr(10), 'Target: ', target, chr(10), 'Rationale: ', rationale) END AS recommended_action,
  CASE WHEN action IS NULL THEN 'analyst' ELSE 'policy' END AS source FROM findings""",
    "remediation_transition_check": "SELECT * FROM (SELECT remediation_id, entry_seq, lag(status) OVER (PARTITION BY remediation_id ORDER BY entry_seq) AS previous_status, status FROM status_timeline) WHERE previous_status IS NOT NULL AND NOT ("
    + " OR ".join(f"(previous_status = '{a}' AND status = '{b}')" for a, t in V.REMEDIATION_TRANSITIONS.items() for b in t) + ")",
    "latest_status": "SELECT remediation_id, arg_max(status, entry_seq) AS status, max(entry_seq) AS entry_seq FROM status_timeline GROUP BY ALL",
}
