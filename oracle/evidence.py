"""The evidence projection as SQL common table expressions (FIXTURES.md, part C)."""

from __future__ import annotations

from postern.functions import fixed_values as V
from postern.sources import testdata as T

ISO = "%Y-%m-%dT%H:%M:%S+00:00"


def q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def case_sql(key: str, mapping, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def bands_sql(key: str, bands, lowest) -> str:
    return (
        "CASE " + " ".join(f"WHEN {key} >= {floor} THEN {q(label)}" for floor, label in bands)
        + f" WHEN {key} IS NOT NULL THEN {q(lowest)} END"
    )


def iso(ts: str) -> str:
    return f"strftime({ts}, '{ISO}')"


def sha(prefix: str, text: str, n: int) -> str:
    return f"concat({q(prefix)}, substr(sha256({text}), 1, {n}))"


def half_even(num: str, den: str) -> str:
    n, d = f"CAST(({num}) AS BIGINT)", f"CAST(({den}) AS BIGINT)"
    return (
        f"(({n}) // ({d}) + CASE WHEN (({n}) % ({d})) * 2 > ({d}) OR ((({n}) % ({d})) * 2 = ({d}) "
        f"AND (({n}) // ({d})) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def suite_name(code: str) -> str:
    return case_sql(code, V.CIPHER_SUITE_NAMES, f"CASE WHEN {code} IS NOT NULL THEN printf('0x%04X', {code}) END")


def suite_class(code: str) -> str:
    return (
        "CASE " + " ".join(f"WHEN {code} IN {codes} THEN {q(name)}" for name, codes in V.CIPHER_CLASS_CODES.items())
        + " ELSE 'unknown' END"
    )


def key_exchange(name: str) -> str:
    return (
        "CASE " + " ".join(f"WHEN starts_with({name}, {q(p)}) THEN {q(f)}" for p, f in V.KEY_EXCHANGE_PREFIXES)
        + " ELSE 'unknown' END"
    )


def profile(position: int, sql_type: str) -> str:
    return f"CAST({case_sql('p', {r[0]: r[position] for r in T.PROFILES if r[position] is not None})} AS {sql_type})"


def _numbers(columns, source, extra="*") -> str:
    """Nested selects, one per derived column, so that each may use the former."""
    sql = source
    for name, expression in columns:
        sql = f"(SELECT {extra}, {expression} AS {name} FROM {sql})"
    return sql


CAP_ID = "concat('capture_', substr(sha256(n_name), 1, 12))"
CASE_ID = "concat('case_', CAST(n_regionkey AS VARCHAR))"
ENDED = "started_at + to_seconds(length_seconds)"

CTES: dict[str, str] = {}

CTES["captures"] = f"""
SELECT {CAP_ID} AS capture_id, CAST(n_nationkey AS BIGINT) AS cap, concat('nation_', CAST(n_nationkey AS VARCHAR), '.pcap') AS filename,
  CASE WHEN n_nationkey % 2 = 0 THEN 'pcap' ELSE 'pcapng' END AS format,
  CAST(n_nationkey AS BIGINT) * 4096 + 24 AS size_bytes, sha256(n_name) AS sha256, 'ready' AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n_nationkey % 12 AS INT)) AS ingested_at
FROM nation"""
CTES["cases"] = """
SELECT concat('case_', CAST(r_regionkey AS VARCHAR)) AS case_id, r_name AS title,
  CASE WHEN r_regionkey % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM region"""
CTES["case_captures"] = f"""
SELECT {CASE_ID} AS case_id, {CAP_ID} AS capture_id,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS idx
FROM nation WHERE n_nationkey <> {T.UNATTACHED_CAPTURE}"""
CTES["baselines"] = f"""
SELECT case_id, capture_id AS baseline_capture_id FROM case_captures
WHERE idx = 0 AND case_id IN {tuple(f'case_{n}' for n in range(T.LAST_CASE_WITH_BASELINE + 1))}"""
CTES["analysis"] = f"""
SELECT capture_id, CASE WHEN cap = {T.FAILED_CAPTURE} THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN cap = {T.FAILED_CAPTURE} THEN 'capture could not be read' END AS warning,
  TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(cap AS INT)) AS analyzed_at
FROM captures WHERE cap <> {T.UNANALYSED_CAPTURE}"""
_base = _numbers(
    T.SESSION_NUMBERS,
    "(SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)",
)
CTES["session_numbers"] = f"""
SELECT b.*, c.capture_id,
  {sha('session_', "concat(c.capture_id, '|tcp|', client_ip, '|', CAST(client_port AS VARCHAR), '|', server_ip, '|', CAST(server_port AS VARCHAR), '|', CAST(o_orderkey AS VARCHAR))", 16)} AS session_id,
  CAST(o_orderdate AS TIMESTAMP) + to_seconds(start_offset) AS started_at
FROM {_base} b JOIN captures c ON b.cap = c.cap"""
CTES["sessions"] = f"""
SELECT session_id, capture_id, client_ip, client_port, server_ip, server_port, protocol, implicit_tls, started_at,
  {ENDED} AS ended_at, CAST(length_seconds AS DOUBLE) AS duration_seconds, packet_count,
  bytes_client_to_server, bytes_server_to_client, complete, cert_no, h, p,
  p NOT IN (1, 7, 9) AS has_starttls,
  CASE WHEN p NOT IN (1, 7, 9) THEN {profile(3, 'BOOLEAN')} END AS advertised,
  CASE WHEN p NOT IN (1, 7, 9) THEN {profile(4, 'BOOLEAN')} END AS requested,
  CASE WHEN p NOT IN (1, 7, 9) THEN {profile(5, 'BOOLEAN')} END AS response_seen,
  p NOT IN (4, 5, 9) AS has_handshake, {profile(1, 'VARCHAR')} AS tls_version, {profile(2, 'INT')} AS code,
  {suite_name(profile(2, 'INT'))} AS cipher_suite,
  CASE WHEN p NOT IN (4, 5, 9) THEN {key_exchange(suite_name(profile(2, 'INT')))} END AS key_exchange,
  CASE WHEN p NOT IN (4, 5, 9) THEN concat('mail', CAST(host AS VARCHAR), '.example.org') END AS sni,
  CASE WHEN p NOT IN (4, 5, 9) THEN p <> 8 END AS handshake_complete,
  CASE WHEN p = 8 THEN 'handshake did not progress beyond the hello exchange' END AS handshake_reason,
  CASE WHEN p NOT IN (4, 5, 9) THEN offered_count ELSE 0 END AS offered_count,
  CASE WHEN p NOT IN (4, 5, 9) THEN 1 + h % 2 + CASE WHEN p = 1 THEN 1 ELSE 0 END ELSE 0 END AS extension_count,
  CASE WHEN p = 1 THEN 2 ELSE 0 END AS alpn_count,
  CASE WHEN p NOT IN (4, 5, 9) THEN 4 + h % 3 END AS client_hello_packet,
  CASE WHEN p NOT IN (4, 5, 9) THEN 6 + h % 3 END AS server_hello_packet
FROM session_numbers"""
CTES["certificates"] = """
SELECT capture_id, session_id, started_at, 0 AS position_in_chain, concat('cert_', substr(fingerprint, 1, 12)) AS certificate_id,
  concat('CN=mail', CAST(k AS VARCHAR), '.example.org') AS subject,
  CASE WHEN k % 4 = 3 THEN concat('CN=mail', CAST(k AS VARCHAR), '.example.org') ELSE concat('CN=Example Issuing CA ', CAST(k % 3 AS VARCHAR)) END AS issuer,
  TIMESTAMP '1994-01-01 00:00:00' + to_days(CAST(30 * k AS INT)) AS not_before,
  TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(120 * k AS INT)) AS not_after,
  CASE WHEN k = 13 THEN 'md5WithRSAEncryption' WHEN k % 6 = 1 THEN 'sha1WithRSAEncryption' ELSE 'sha256WithRSAEncryption' END AS signature_algorithm,
  CASE WHEN k = 9 THEN 'Ed25519' WHEN k % 7 = 0 THEN 'EC' ELSE 'RSA' END AS public_key_algorithm,
  CASE WHEN k = 9 THEN NULL WHEN k % 7 = 0 THEN 256 WHEN k % 5 = 1 THEN 1024 ELSE 2048 END AS public_key_size_bits,
  CASE WHEN k % 5 = 2 THEN ['other.example.org'] ELSE ['*.example.org', 'example.org'] END AS sans,
  fingerprint AS fingerprint_sha256
FROM (SELECT capture_id, session_id, started_at, cert_no AS k, sha256(concat('cert', CAST(cert_no AS VARCHAR))) AS fingerprint FROM sessions WHERE cert_no IS NOT NULL)
UNION ALL
SELECT capture_id, session_id, started_at, 1, concat('cert_', substr(fingerprint, 1, 12)),
  concat('CN=Example Issuing CA ', CAST(k % 3 AS VARCHAR)), 'CN=Example Root CA',
  TIMESTAMP '1990-01-01 00:00:00', TIMESTAMP '2030-01-01 00:00:00', 'sha256WithRSAEncryption', 'RSA', 4096, [], fingerprint
FROM (SELECT capture_id, session_id, started_at, cert_no AS k, sha256(concat('issuer', CAST(cert_no % 3 AS VARCHAR))) AS fingerprint FROM sessions
  WHERE cert_no % 2 = 0 OR cert_no = 11)"""
_events = (
    ("1", "'connection_established'", "'unknown'", "started_at", "1", "'basis'", "'syn'"),
    ("TRUE", "'server_greeting'", "'server_to_client'", "started_at", "2", "'greeting'", "protocol"),
    ("advertised", "'starttls_advertised'", "'server_to_client'", "started_at", "2", "'capability'", "'STARTTLS'"),
    ("requested", "'starttls_requested'", "'client_to_server'", "started_at", "3", "'tag'", "''"),
    ("response_seen", "'starttls_response'", "'server_to_client'", "started_at", "3", "'tag'", "''"),
    ("p = 9 AND h % 2 = 1 AND protocol = 'imap'", "'authentication'", "'client_to_server'", "started_at", "5", "'command'", "'LOGIN'"),
    ("p = 9 AND h % 2 = 1 AND protocol = 'smtp'", "'authentication'", "'client_to_server'", "started_at", "5", "'mechanism'", "'PLAIN'"),
    ("p = 9 AND h % 2 = 1 AND protocol = 'pop3'", "'authentication'", "'client_to_server'", "started_at", "5", "'command'", "'USER'"),
    ("p = 9 AND h % 2 = 1 AND protocol = 'pop3'", "'authentication'", "'client_to_server'", "started_at", "6", "'command'", "'PASS'"),
    ("complete", "'connection_closed'", "'unknown'", "ended_at", "packet_count", "'basis'", "'fin'"),
)
CTES["session_events"] = (
    "SELECT capture_id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n) - 1 AS BIGINT) AS seq, "
    "type, direction, ts, packet, detail_key, detail_value FROM ("
    + " UNION ALL ".join(
        f"SELECT capture_id, session_id, {i} AS n, {kind} AS type, {direction} AS direction, {ts} AS ts, "
        f"CAST({packet} AS INT) AS packet, {key} AS detail_key, {value} AS detail_value FROM sessions WHERE {cond}"
        for i, (cond, kind, direction, ts, packet, key, value) in enumerate(_events)
    ).replace("WHERE 1", "WHERE TRUE")
    + ")"
)
CTES["anomalies"] = f"""
SELECT {sha('anomaly_', 'session_id', 12)} AS anomaly_id, capture_id, session_id, protocol,
  coalesce({bands_sql('score', V.ANOMALY_BANDS, 'normal')}, 'insufficient_evidence') AS status,
  CAST(score AS INT) AS score, {bands_sql('score', V.ANOMALY_BANDS, 'normal')} AS band
FROM {_numbers(T.ANOMALY_NUMBERS, 'session_numbers')}"""
CTES["notes"] = f"""
SELECT {sha('note_', 'CAST(c_custkey AS VARCHAR)', 16)} AS note_id, {CASE_ID} AS case_id,
  CASE c_custkey % 4 WHEN 0 THEN 'session' WHEN 1 THEN 'capture' WHEN 2 THEN 'case' ELSE 'finding' END AS target_type,
  CASE c_custkey % 4 WHEN 0 THEN coalesce(s.session_id, 'session_missing') WHEN 1 THEN {CAP_ID} WHEN 2 THEN {CASE_ID}
    ELSE concat('finding_', CAST(c_custkey AS VARCHAR)) END AS target_id,
  concat('note on ', CAST(c_custkey AS VARCHAR)) AS body, c_custkey AS created_order
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN session_numbers s ON s.o_orderkey = c_custkey"""
CTES["bookmarks"] = f"""
SELECT {sha('bookmark_', 'CAST(s_suppkey AS VARCHAR)', 16)} AS bookmark_id, {CASE_ID} AS case_id, 'capture' AS target_type,
  CASE WHEN s_suppkey % 3 <> 0 THEN {CAP_ID} ELSE concat('capture_', substr(sha256(s_name), 1, 12)) END AS target_id, s_name AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
CTES["case_timeline"] = f"""
SELECT {sha('timeline_', 'CAST(event_id AS VARCHAR)', 16)} AS entry_id,
  concat('case_', CAST(user_id % 5 AS VARCHAR)) AS case_id, event_id AS insert_order, event_type, ts AS created_at,
  c.capture_id AS detail_capture_id
FROM events JOIN captures c ON c.cap = event_id % 25"""
