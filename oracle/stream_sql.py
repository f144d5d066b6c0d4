"""Streams under availableNow, and sinks, as SQL."""

from __future__ import annotations

from oracle.evidence import iso
from oracle.findings_sql import BODIES as F

_counts = lambda starts: f"""SELECT {iso('w')} AS window_start, severity, count(*) AS findings FROM (SELECT severity, {starts} AS w FROM findings) GROUP BY ALL"""
BODIES = {
    "stream_rules": F["evaluate_all_rules"],
    "stream_flow_sessions": """
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 1800000000 AS closed_us, count(*) AS packets FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, run""",
    "stream_finding_counts": _counts("date_trunc('hour', detected_at)"),
    "stream_finding_counts_sliding": _counts("unnest([time_bucket(INTERVAL 15 MINUTE, detected_at) - to_minutes(15 * k) for k in [0, 1, 2, 3]])"),
    "stream_capture_dedup": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
    "sink_replace_capture": "SELECT finding_id, session_id, rule_id, severity, capture_id FROM findings",
    "sink_json_document": "SELECT finding_id, rule_id, severity, observed_value, expected_value FROM findings",
    "report_document": """
SELECT concat('{"capture_id":"', capture_id, '","handshakes_complete":', count(*) FILTER (handshake_complete), ',"sessions_total":', count(*), ',"sessions_with_starttls":', count(*) FILTER (has_starttls),
  ',"sessions_with_tls_handshake":', count(*) FILTER (has_handshake), '}') AS value FROM sessions GROUP BY capture_id""",
}
