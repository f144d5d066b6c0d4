"""Features, baselines and deviations as SQL."""

from __future__ import annotations

from oracle.evidence import CTES, bands_sql, case_sql, suite_class
from postern.functions import fixed_values as V

INDEX = lambda f, c: case_sql(c, {w: i for i, w in enumerate(V.CATEGORICAL_VOCABULARIES[f])}, str(len(V.CATEGORICAL_VOCABULARIES[f]) - 1))
LABEL = lambda f, c: case_sql(c, dict(enumerate(V.CATEGORICAL_VOCABULARIES[f])), "'other'")
CAT = tuple(V.CATEGORICAL_VOCABULARIES)
NUM = tuple(n for n in V.FEATURE_NAMES if n not in CAT)
COL = {"protocol": "protocol_index"}
values = {
    "protocol": INDEX("protocol", "s.protocol"), "server_port": "server_port", "duration_seconds": "duration_seconds", "packet_count": "packet_count",
    "bytes_client_to_server": "bytes_client_to_server", "bytes_server_to_client": "bytes_server_to_client", "tcp_complete": "CAST(complete AS INT)", "has_tls": "CAST(has_handshake AS INT)",
    "tls_version": INDEX("tls_version", "coalesce(tls_version, 'unknown')"), "cipher_class": INDEX("cipher_class", suite_class("code")), "offered_cipher_count": "offered_count",
    "key_exchange": INDEX("key_exchange", "coalesce(key_exchange, 'unknown')"), "extension_count": "extension_count", "has_sni": "CAST(has_handshake AS INT)", "alpn_count": "alpn_count",
    "certificate_count": "coalesce(c.n, 0)", "certificate_max_key_bits": "coalesce(c.bits, 0)", "certificate_min_validity_days": "coalesce((epoch(c.ends) - epoch(s.started_at)) / 86400, 0)",
    "has_implicit_tls": "CAST(implicit_tls AS INT)",
}
CTES["features"] = (
    "SELECT s.capture_id, s.session_id, s.protocol AS protocol_group, " + ", ".join(f"CAST({values[n]} AS DOUBLE) AS {COL.get(n, n)}" for n in V.FEATURE_NAMES)
    + " FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, max(coalesce(public_key_size_bits, 0)) AS bits, min(not_after) AS ends FROM certificates GROUP BY session_id) c USING (session_id)"
)
CTES["numeric_rows"] = " UNION ALL ".join(f"SELECT capture_id, protocol_group, session_id, '{n}' AS feature, {V.FEATURE_NAMES.index(n)} AS position, {n} AS value FROM features" for n in NUM)
CTES["category_rows"] = " UNION ALL ".join(f"SELECT capture_id, protocol_group, session_id, '{n}' AS feature, {V.FEATURE_NAMES.index(n)} AS position, {LABEL(n, COL.get(n, n))} AS label FROM features" for n in CAT)
CTES["deviations"] = """
SELECT session_id, feature, position, round(CASE WHEN std <= 1e-9 THEN 0 ELSE round(abs(value - mean) / std, 2) END, 2) AS score FROM numeric_rows JOIN (
  SELECT capture_id, protocol_group, feature, avg(value) AS mean, stddev_pop(value) AS std FROM numeric_rows GROUP BY ALL) USING (capture_id, protocol_group, feature)
WHERE NOT (std <= 1e-9 AND abs(value - mean) <= 1e-9)
UNION ALL SELECT session_id, feature, position, round(1 - n / total, 2) FROM category_rows JOIN (SELECT capture_id, protocol_group, feature, label, count(*) AS n FROM category_rows GROUP BY ALL) USING (capture_id, protocol_group, feature, label)
JOIN (SELECT capture_id, protocol_group, count(*) AS total FROM features GROUP BY ALL) USING (capture_id, protocol_group)"""
CTES["enough"] = "SELECT session_id FROM features JOIN (SELECT capture_id, protocol_group FROM features GROUP BY ALL HAVING count(*) >= 8) USING (capture_id, protocol_group)"
SCORE = "round_even(100 / (1 + exp((l_extendedprice - 50000) / 200000 * 20)), 0)"
BODIES = {
    "session_features": "SELECT * EXCLUDE (certificate_min_validity_days), CAST(round(certificate_min_validity_days * 86400) AS BIGINT) AS certificate_min_validity_seconds FROM features",
    "decode_feature": "SELECT session_id, " + ", ".join(f"{LABEL(n, COL.get(n, n))} AS {n}" for n in CAT) + f", {LABEL('protocol', 'packet_count')} AS outside FROM features",
    "baseline_stats": "SELECT capture_id, protocol_group, feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM numeric_rows GROUP BY ALL",
    "baseline_categorical": "SELECT capture_id, protocol_group, feature, label, count(*) AS n FROM category_rows GROUP BY ALL",
    "baseline_gate": "SELECT capture_id, protocol_group, count(*) AS sessions, count(*) >= 8 AS sufficient FROM features GROUP BY ALL",
    "min_baseline_param": "SELECT capture_id, protocol_group, count(*) AS sessions, count(*) >= 150 AS sufficient FROM features GROUP BY ALL",
    "feature_deviation": "SELECT session_id, feature, round(score, 1) AS score FROM deviations SEMI JOIN enough USING (session_id)",
    "top_deviations": "SELECT session_id, count(*) AS deviations, round(max(score), 1) AS highest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, position) AS n FROM deviations SEMI JOIN enough USING (session_id)) WHERE n <= 4 AND score > 0 GROUP BY ALL",
    "anomaly_score_map": f"SELECT CAST({SCORE} AS BIGINT) AS score, {bands_sql(SCORE, V.ANOMALY_BANDS, 'normal')} AS band, count(*) AS n FROM lineitem GROUP BY ALL",
    "anomaly_summary": """
SELECT capture_id, count(*) FILTER (status = 'normal') AS normal, count(*) FILTER (status = 'unusual') AS unusual, count(*) FILTER (status = 'anomalous') AS anomalous, count(*) FILTER (status = 'highly_anomalous') AS highly_anomalous,
  count(*) FILTER (status = 'insufficient_evidence') AS insufficient_evidence, CAST(0 AS BIGINT) AS model_error, count(score) AS total_evaluated, count(*) AS total_sessions FROM anomalies GROUP BY capture_id""",
}
