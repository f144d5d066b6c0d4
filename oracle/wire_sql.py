"""Packets, streams and sessions as SQL, from the same dialogue expressions."""

from __future__ import annotations

import re

import oracle.graph_sql  # noqa: F401  nodes and edges
from oracle.compose import WORD
from oracle.evidence import CTES, case_sql, iso, q, sha
from oracle.findings import findings_sql
from oracle.findings_sql import FLAT
from oracle.posture_sql import BODIES as POSTURE_BODIES
from postern.functions import fixed_values as V
from postern.sources import wire as X


def duck(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


_steps = " UNION ALL ".join(f"SELECT session_id, {i + 2} AS i, '{d}' AS d, 24 AS f, {duck(x)} AS x FROM session_numbers WHERE {cond}" for i, (d, cond, x) in enumerate(X.STEPS))
CTES["dialogue"] = _steps
CTES["sent"] = f"""
SELECT session_id, i, d, f, x, CASE WHEN d = 'c' THEN {X.CLIENT_ISN} ELSE {X.SERVER_ISN} END + 1 + coalesce(sum(length(x) // 2) OVER (PARTITION BY session_id, d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq
FROM dialogue JOIN session_numbers USING (session_id)"""
CTES["packets"] = f"""
SELECT session_id AS capture_id, number, CAST(epoch(started_at) + number - 1 AS DOUBLE) AS ts, d,
  CASE WHEN d = 'c' THEN client_ip ELSE server_ip END AS src_ip, CASE WHEN d = 'c' THEN server_ip ELSE client_ip END AS dst_ip,
  CASE WHEN d = 'c' THEN client_port ELSE server_port END AS src_port, CASE WHEN d = 'c' THEN server_port ELSE client_port END AS dst_port,
  f AS tcp_flags, CAST(seq % 4294967296 AS BIGINT) AS tcp_seq, CAST(length(x) // 2 AS BIGINT) AS captured_len, x, raw, protocol, implicit_tls, p, h, i
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS number FROM (
  SELECT session_id, 0 AS i, 'c' AS d, 2 AS f, '' AS x, {X.CLIENT_ISN} AS seq, {X.CLIENT_ISN} AS raw FROM session_numbers
  UNION ALL SELECT session_id, 1, 's', 18, '', {X.SERVER_ISN}, {X.SERVER_ISN} FROM session_numbers
  UNION ALL SELECT session_id, i, d, f, x, seq, seq FROM sent
  UNION ALL SELECT session_id, 90, 'c', 24, arg_min(x, i), min(seq), min(seq) FROM sent JOIN (SELECT session_id FROM session_numbers WHERE {X.RETRANSMIT}) USING (session_id) WHERE d = 'c' GROUP BY session_id
  UNION ALL SELECT session_id, 99, 'c', 17, '', max(seq + length(x) // 2) FILTER (d = 'c'), 0 FROM sent JOIN (SELECT session_id FROM session_numbers WHERE complete) USING (session_id) GROUP BY session_id))
JOIN session_numbers USING (session_id)"""
FLOW = "concat('tcp|', client_ip, '|', CAST(client_port AS VARCHAR), '|', server_ip, '|', CAST(server_port AS VARCHAR))"
SID = f"concat('session_', substr(sha256(concat(session_id, '|', {FLOW})), 1, 16))"
CTES["wire_flows"] = f"""
SELECT n.session_id AS capture_id, {SID.replace('session_id,', 'n.session_id,')} AS session_id, {FLOW} AS flow, k.* EXCLUDE (capture_id), n.protocol, n.implicit_tls, n.p, n.h, n.complete
FROM session_numbers n JOIN (SELECT capture_id, count(*) AS packet_count, count(*) FILTER (d = 'c') AS packets_a, count(*) FILTER (d = 's') AS packets_b, min(ts) AS first_ts, max(ts) AS last_ts FROM packets GROUP BY ALL) k ON k.capture_id = n.session_id"""
CTES["line_segments"] = """
SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number,
  (CAST(l_linenumber AS BIGINT) - 1) * 25 AS s, (CAST(l_linenumber AS BIGINT) - 1) * 25 + CAST(l_quantity AS BIGINT) AS e, l_linestatus = 'F' AS fin FROM lineitem"""
CTES["coverage"] = """
SELECT flow, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS bytes_reconstructed, count(*) FILTER (s > reach) AS gap_count, CAST(sum(greatest(0, s - coalesce(reach, s))) AS BIGINT) AS gap_bytes, bool_or(fin) AS fin
FROM (SELECT *, max(e) OVER (PARTITION BY flow ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM line_segments) GROUP BY flow"""
ENDED = "CASE WHEN complete THEN 'fin' WHEN NOT implicit_tls AND p NOT IN (0, 2, 3, 6, 8, 10, 11) THEN 'protocol' END"
RESP, REQ, ADV = X.RESP, X.REQ, X.ADV
TLSROWS = "SELECT session_id AS capture_id, * EXCLUDE (capture_id, session_id) FROM sessions WHERE has_handshake"


def events(protocol: str) -> str:
    """Expected event counts of every plaintext dialogue of a protocol."""
    auth = {"smtp": 1, "imap": 1, "pop3": 2}[protocol]
    # Server responses to the first command, and to the second when it is not an accepted upgrade.
    first = {"smtp": "1 + CASE WHEN NOT adv THEN 0 ELSE 0 END + 1", "imap": "1", "pop3": "1"}[protocol]
    mail = protocol == "smtp"
    rows = [
        ("server_greeting", "1", "TRUE"), ("starttls_advertised", "1", "adv"), ("starttls_requested", "1", "req"), ("starttls_response", "1", "resp"), ("tls_transition", "1", "resp"),
        ("authentication", str(auth), "login"),
        ("mail_transaction_start", "1", "NOT req AND NOT login" if mail else "FALSE"),
        ("client_command", f"1 + CASE WHEN NOT req AND NOT login AND {not mail} THEN 1 ELSE 0 END + CASE WHEN NOT resp THEN 1 ELSE 0 END", "TRUE"),
        ("server_response", f"{first} + CASE WHEN resp THEN 0 ELSE 1 END + CASE WHEN NOT resp THEN 1 ELSE 0 END", "TRUE"),
    ]
    base = f"SELECT session_id AS capture_id, {ADV} AS adv, {REQ} AS req, {RESP} AS resp, (p = 9 AND h % 2 = 1) AS login FROM session_numbers WHERE protocol = '{protocol}' AND NOT implicit_tls"
    return " UNION ALL ".join(f"SELECT capture_id, '{kind}' AS type, CAST({n} AS BIGINT) AS n FROM ({base}) WHERE {cond}" for kind, n, cond in rows)



# Rebuilt sessions, their findings and posture: the stored definitions over wire tables.
CTES["wire_numbers"] = "SELECT capture_id, min(number) FILTER (i = 7) AS client_hello, min(number) FILTER (i = 8) AS server_hello, min(number) FILTER (i = 5) AS request FROM packets GROUP BY capture_id"
CTES["wire_session_rows"] = """
SELECT s.* EXCLUDE (capture_id, session_id, ended_at, client_hello_packet, server_hello_packet), s.session_id AS capture_id, f.session_id AS session_id,
  make_timestamp(CAST(last_ts AS BIGINT) * 1000000) AS ended_at, CASE WHEN has_handshake THEN client_hello END AS client_hello_packet, CASE WHEN has_handshake THEN server_hello END AS server_hello_packet, request
FROM sessions s JOIN wire_flows f ON f.capture_id = s.session_id JOIN wire_numbers n ON n.capture_id = s.session_id"""
CTES["wire_judged"] = """
SELECT s.*, l.subject AS leaf_subject, l.issuer AS leaf_issuer, l.not_before AS leaf_before, l.not_after AS leaf_after, l.signature_algorithm AS sig, l.public_key_algorithm AS key_alg,
  l.public_key_size_bits AS key_bits, l.sans, i.subject AS issuer_subject, CASE WHEN l.subject IS NULL THEN 0 WHEN i.subject IS NULL THEN 1 ELSE 2 END AS chain_length,
  CASE WHEN p = 9 AND h % 2 = 1 THEN CASE protocol WHEN 'imap' THEN 'LOGIN' WHEN 'smtp' THEN 'PLAIN' ELSE 'USER, PASS' END END AS auth_commands, request AS auth_first, request AS auth_last
FROM wire_session_rows s
LEFT JOIN (SELECT * FROM certificates WHERE position_in_chain = 0) l ON l.session_id = s.capture_id LEFT JOIN (SELECT * FROM certificates WHERE position_in_chain = 1) i ON i.session_id = s.capture_id"""
CTES["wire_finding_rows"] = findings_sql(V.FACTOR_BY_RULE).replace("FROM judged", "FROM wire_judged").replace("CASE WHEN requested THEN 3 END", "CASE WHEN requested THEN request END")


def rewired(name: str, renamed: dict[str, str]) -> str:
    """A CTE and all it is built on, with other tables beneath; gives the new name."""
    if name in renamed:
        return renamed[name]
    body = CTES[name]
    for word in sorted(set(WORD.findall(body)) & CTES.keys() - {name}):
        if needs(word, set(renamed)):
            body = re.sub(rf"\b{word}\b", rewired(word, renamed), body)
    renamed[name] = f"wire_{name}"
    CTES[renamed[name]] = body
    return renamed[name]


def needs(name: str, below: set[str]) -> bool:
    return name in below or any(needs(w, below) for w in set(WORD.findall(CTES.get(name, ""))) & CTES.keys() - {name})


def rewired_body(body: str) -> str:
    renamed = {"sessions": "wire_session_rows", "findings": "wire_finding_rows", "captures": "wire_capture_rows", "session_events": "wire_session_events", "anomalies": "wire_no_anomalies"}
    below = set(renamed)
    for word in sorted(set(WORD.findall(body)) & CTES.keys()):
        if needs(word, below):
            body = re.sub(rf"\b{word}\b", rewired(word, renamed), body)
    return body


CTES["wire_capture_rows"] = "SELECT DISTINCT capture_id FROM wire_session_rows"
# Every event of a dialogue: protocol, step, line of the step, condition, type, direction, detail.
C2S, S2C = "client_to_server", "server_to_client"
UPGRADE = (("resp", "starttls_response", {}), ("resp", "tls_transition", {"phase": V.ENCRYPTED_STREAM_PHASE}))


def _expected():
    for protocol, greeting in (("smtp", {"banner": "220 mail ESMTP ready"}), ("imap", {"greeting": "* OK ready"}), ("pop3", {"greeting": "+OK ready"})):
        yield protocol, 2, 0, "TRUE", "server_greeting", S2C, greeting
        tag = lambda n, protocol=protocol: {"tag": f"a{n}"} if protocol == "imap" else {}
        yield protocol, 5, 0, "req", "starttls_requested", C2S, tag(2)
        yield protocol, 6, 0, "resp", "starttls_response", S2C, tag(2)
        yield protocol, 6, 1, "resp", "tls_transition", S2C, {"phase": V.ENCRYPTED_STREAM_PHASE}
        yield protocol, 4, 1, "adv", "starttls_advertised", S2C, {"capability": "STLS" if protocol == "pop3" else "STARTTLS"}
    yield "smtp", 3, 0, "TRUE", "client_command", C2S, {"argument": "client.example.org", "command": "EHLO"}
    yield "smtp", 4, 0, "TRUE", "server_response", S2C, {"code": "250"}
    yield "smtp", 4, 2, "TRUE", "server_response", S2C, {"code": "250"}
    yield "smtp", 5, 0, "login", "authentication", C2S, {"credential_data": "redacted", "mechanism": "PLAIN"}
    yield "smtp", 5, 0, "NOT req AND NOT login", "mail_transaction_start", C2S, {"envelope": "FROM:<a@example.org>"}
    yield "smtp", 6, 0, "req AND NOT resp", "server_response", S2C, {"code": "454"}
    yield "smtp", 6, 0, "login", "server_response", S2C, {"code": "235"}
    yield "smtp", 6, 0, "NOT req AND NOT login", "server_response", S2C, {"code": "250"}
    yield "smtp", 9, 0, "NOT resp", "client_command", C2S, {"command": "QUIT"}
    yield "smtp", 10, 0, "NOT resp", "server_response", S2C, {"code": "221"}
    yield "imap", 3, 0, "TRUE", "client_command", C2S, {"argument": "", "command": "CAPABILITY", "tag": "a1"}
    yield "imap", 4, 2, "TRUE", "server_response", S2C, {"status": "OK", "tag": "a1"}
    yield "imap", 5, 0, "login", "authentication", C2S, {"command": "LOGIN", "credential_data": "redacted", "tag": "a2"}
    yield "imap", 5, 0, "NOT req AND NOT login", "client_command", C2S, {"argument": "", "command": "NOOP", "tag": "a2"}
    yield "imap", 6, 0, "req AND NOT resp", "server_response", S2C, {"status": "NO", "tag": "a2"}
    yield "imap", 6, 0, "NOT req", "server_response", S2C, {"status": "OK", "tag": "a2"}
    yield "imap", 9, 0, "NOT resp", "client_command", C2S, {"argument": "", "command": "LOGOUT", "tag": "a3"}
    yield "imap", 10, 0, "NOT resp", "server_response", S2C, {"status": "OK", "tag": "a3"}
    yield "pop3", 3, 0, "TRUE", "client_command", C2S, {"command": "CAPA"}
    yield "pop3", 4, 0, "TRUE", "server_response", S2C, {"status": "OK"}
    for k, command in enumerate(("USER", "PASS")):
        yield "pop3", 5, k, "login", "authentication", C2S, {"argument": "redacted", "command": command}
    yield "pop3", 5, 0, "NOT req AND NOT login", "client_command", C2S, {"command": "STAT"}
    yield "pop3", 6, 0, "req AND NOT resp", "server_response", S2C, {"status": "ERR"}
    yield "pop3", 6, 0, "NOT req", "server_response", S2C, {"status": "OK"}
    yield "pop3", 9, 0, "NOT resp", "client_command", C2S, {"command": "QUIT"}
    yield "pop3", 10, 0, "NOT resp", "server_response", S2C, {"status": "OK"}


_rows = ", ".join("(" + ", ".join([q(protocol), str(i), str(k), q(kind), q(side), q(";".join(f"{a}={b}" for a, b in sorted(detail.items()))), str(n)]) + ")" for n, (protocol, i, k, _, kind, side, detail) in enumerate(_expected()))
_when = "CASE n " + " ".join(f"WHEN {n} THEN {row[3]}" for n, row in enumerate(_expected())) + " END"
CTES["wire_event_rows"] = f"""
SELECT session_id AS capture_id, i, k, type, direction, detail FROM (
  SELECT *, {X.ADV} AS adv, {X.REQ} AS req, {X.RESP} AS resp, (p = 9 AND h % 2 = 1) AS login FROM session_numbers WHERE NOT implicit_tls) d
JOIN (VALUES {_rows}) e(protocol, i, k, type, direction, detail, n) ON e.protocol = d.protocol AND {_when}"""
CTES["wire_timeline_rows"] = f"""
SELECT capture_id, number, 1 AS part, k, type, direction, detail, ts FROM wire_event_rows JOIN (SELECT capture_id, i, number, ts FROM packets) USING (capture_id, i)
UNION ALL SELECT capture_id, 1, 0, 0, 'connection_established', 'unknown', 'basis=syn', first_ts FROM wire_flows
UNION ALL SELECT capture_id, packet_count, 2, 0, 'connection_closed', 'unknown', concat('basis=', {ENDED}), last_ts FROM wire_flows WHERE {ENDED} IS NOT NULL"""
CTES["wire_lines"] = """
SELECT capture_id, number, d, k, text, sum(strlen(text) + 2) OVER w - strlen(text) - 2 AS line_offset, sum(strlen(text) + 2) OVER w AS line_end
FROM (SELECT capture_id, number, d, unnest(range(1, len(parts))) AS k, unnest(parts[1:-2]) AS text FROM (
  SELECT session_id AS capture_id, number, s.d, string_split(decode(unhex(s.x)), concat(chr(13), chr(10))) AS parts
  FROM sent s JOIN (SELECT capture_id, i, number FROM packets) k ON k.capture_id = s.session_id AND k.i = s.i JOIN (SELECT session_id, implicit_tls FROM session_numbers) n USING (session_id) WHERE s.i NOT IN (7, 8)))
WINDOW w AS (PARTITION BY capture_id, d ORDER BY number, k ROWS UNBOUNDED PRECEDING)"""

CTES["wire_session_events"] = f"""
SELECT t.capture_id, f.session_id, row_number() OVER (PARTITION BY t.capture_id ORDER BY number, part, k) - 1 AS seq, type, direction, ts, CAST(number AS INT) AS packet, detail
FROM wire_timeline_rows t JOIN wire_flows f USING (capture_id)"""
CTES["wire_no_anomalies"] = "SELECT * FROM anomalies WHERE FALSE"
GRAPH_COUNTS = """
SELECT capture_id, node_type AS type, count(*) AS n, 'node' AS part FROM nodes GROUP BY ALL UNION ALL SELECT capture_id, edge_type, count(*), 'edge' FROM edges GROUP BY ALL"""


BODIES = {
    "src_captures": "SELECT 'pcap' AS format, count(*) AS captures, CAST(sum(24 + n) AS BIGINT) AS bytes FROM (SELECT capture_id, sum(70 + captured_len) AS n FROM packets GROUP BY ALL)",
    "src_packets": "SELECT capture_id, number, ts, src_ip, dst_ip, src_port, dst_port, tcp_flags, tcp_seq, captured_len, md5(unhex(x)) AS payload_md5 FROM packets",
    "packet_skip_coverage": """
SELECT CASE WHEN n % 2 = 0 THEN 'truncated packet record' ELSE 'non-ipv4 ethernet frame' END AS reason, count(*) AS captures, count(*) AS packets
FROM (SELECT sum(70 + captured_len) AS n FROM packets GROUP BY capture_id) GROUP BY ALL""",
    "capture_packet_metadata": f"""
SELECT capture_id, packet_count, {iso('make_timestamp(CAST(first_ts AS BIGINT) * 1000000)')} AS capture_started_at, {iso('make_timestamp(CAST(last_ts AS BIGINT) * 1000000)')} AS capture_ended_at, last_ts - first_ts AS duration_seconds, 'Ethernet' AS link_type FROM wire_flows""",
    "tcp_flags_label": "SELECT capture_id, number, CASE tcp_flags WHEN 2 THEN 'SYN' WHEN 18 THEN 'SYN+ACK' WHEN 24 THEN 'PSH+ACK' ELSE 'FIN+ACK' END AS flags FROM packets",
    "flow_key": "SELECT p.capture_id, p.number, f.flow, CASE WHEN d = 'c' THEN 'a' ELSE 'b' END AS direction FROM packets p JOIN wire_flows f USING (capture_id)",
    "session_id": "SELECT capture_id, session_id FROM wire_flows",
    "flow_build": "SELECT capture_id, session_id, flow, packet_count, packets_a, packets_b FROM wire_flows",
    "flow_first_last": "SELECT session_id, 1 AS first_packet, packet_count AS last_packet, last_ts - first_ts AS duration FROM wire_flows",
    "flow_orientation": "SELECT capture_id, flow, 'b' AS server_side, 'syn' AS basis FROM wire_flows",
    "seq_normalize": f"SELECT capture_id, CASE WHEN d = 'c' THEN 'a' ELSE 'b' END AS direction, number, CAST(raw - CASE WHEN d = 'c' THEN {X.CLIENT_ISN} ELSE {X.SERVER_ISN} END - 1 AS BIGINT) AS start, CAST(raw - CASE WHEN d = 'c' THEN {X.CLIENT_ISN} ELSE {X.SERVER_ISN} END - 1 + captured_len AS BIGINT) AS end, FALSE AS stale FROM packets WHERE captured_len > 0",
    "stream_coverage": "SELECT flow, bytes_reconstructed, gap_count, gap_bytes FROM coverage",
    "stream_completeness": """
SELECT flow, gap_count = 0 AND fin AS complete, CASE WHEN NOT (gap_count = 0 AND fin) THEN concat_ws('; ', CASE WHEN gap_count > 0 THEN concat(CAST(gap_count AS VARCHAR), ' gap(s) covering ', CAST(gap_bytes AS VARCHAR), ' byte(s)') END,
  CASE WHEN NOT fin THEN 'no FIN or RST observed (no graceful termination)' END) END AS reason FROM coverage""",
    "stream_bytes": f"""
SELECT p.capture_id, CASE WHEN d = 'c' THEN 'a' ELSE 'b' END AS direction, CAST(sum(length(x) // 2) AS BIGINT) AS bytes, CAST(max(CASE WHEN d = 'c' AND {X.RETRANSMIT} THEN 1 ELSE 0 END) AS BIGINT) AS duplicate, CAST(0 AS BIGINT) AS retransmitted,
  sha256(string_agg(upper(x), '' ORDER BY i)) AS hex_sha256
FROM (SELECT session_id AS capture_id, i, d, x, h FROM sent JOIN (SELECT session_id, h FROM session_numbers) USING (session_id)) p GROUP BY ALL""",
    "port_protocol": f"SELECT DISTINCT dst_port, {case_sql('dst_port', V.PORT_PROTOCOLS)} AS protocol, dst_port IN {V.IMPLICIT_TLS_PORTS} AS implicit FROM packets",
    "protocol_detect": "SELECT capture_id, CASE WHEN NOT implicit_tls THEN protocol END AS protocol, CASE WHEN implicit_tls THEN 'low' ELSE 'high' END AS confidence, 'b' AS server_side FROM wire_flows",
    "conversation_lines": "SELECT capture_id, CASE protocol WHEN 'imap' THEN '* OK ready' WHEN 'pop3' THEN '+OK ready' ELSE '220 mail ESMTP ready' END AS greeting FROM wire_flows WHERE NOT implicit_tls",
    "conversation_merge": """
SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY number, k) AS line_no, CASE d WHEN 's' THEN 'server_to_client' ELSE 'client_to_server' END AS side,
  CAST(line_offset AS BIGINT) AS line_offset, CAST(line_end AS BIGINT) AS line_end, text, CAST(number AS VARCHAR) AS packets FROM wire_lines""",
    "smtp_events": events("smtp"), "imap_events": events("imap"), "pop3_events": events("pop3"),
    "connection_events": f"SELECT capture_id, 'connection_established' AS type, 1 AS packet, 'syn' AS basis FROM wire_flows UNION ALL SELECT capture_id, 'connection_closed', packet_count, {ENDED} FROM wire_flows WHERE {ENDED} IS NOT NULL",
    "event_numbering": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events",
    "starttls_observation": f"SELECT session_id AS capture_id, advertised, requested, response_seen FROM sessions WHERE NOT implicit_tls AND has_starttls",
    "tls_hello_facts": f"""
SELECT s.session_id AS capture_id, TRUE AS client_seen, TRUE AS server_seen, code AS selected, sni, CASE WHEN p = 1 THEN 'imap, pop3' END AS alpn, p <> 8 AS progressed,
  concat(CASE WHEN p = 1 THEN 'supported_versions=2=TLS 1.3;' ELSE '' END, 'server_name=23=', sni, CASE WHEN p = 1 THEN ';supported_versions=3=TLS 1.3;application_layer_protocol_negotiation=12=imap, pop3' ELSE '' END) AS extensions,
  concat(CAST(code AS VARCHAR), ',4865') AS offered, CAST(client_hello AS VARCHAR) AS client_packets, CAST(server_hello AS VARCHAR) AS server_packets,
  CASE WHEN cert_no IS NULL THEN '' ELSE concat(sha256(concat('cert', CAST(cert_no AS VARCHAR))), CASE WHEN cert_no % 2 = 0 OR cert_no = 11 THEN concat(',', sha256(concat('issuer', CAST(cert_no % 3 AS VARCHAR)))) ELSE '' END) END AS fingerprints,
  CASE WHEN cert_no IS NULL THEN 'no plaintext Certificate message observed in the server stream' ELSE '' END AS warnings
FROM sessions s JOIN wire_numbers n ON n.capture_id = s.session_id WHERE has_handshake""",
    "negotiated_version": "SELECT session_id AS capture_id, tls_version FROM sessions WHERE has_handshake",
    "handshake_complete": "SELECT session_id AS capture_id, p <> 8 AS handshake_complete, CASE WHEN p = 8 THEN 'handshake did not progress beyond the hello exchange' END AS reason FROM sessions WHERE has_handshake",
    "implicit_protocol_inference": "SELECT session_id AS capture_id, protocol, 'medium' AS confidence, 'client_server' AS orientation FROM sessions WHERE implicit_tls",
    "session_build": f"""
SELECT s.session_id AS capture_id, client_ip, client_port, server_ip, server_port, s.protocol, 'client_server' AS orientation, s.implicit_tls, s.complete,
  CASE WHEN NOT s.complete THEN 'no FIN or RST observed (no graceful termination)' END AS completeness_reason, advertised, requested, response_seen,
  tls_version, cipher_suite, key_exchange, sni, handshake_complete, f.packet_count, CAST(0 AS BIGINT) AS gap_count, CAST(0 AS BIGINT) AS retransmissions, {iso('started_at')} AS started_at
FROM sessions s JOIN wire_flows f ON f.capture_id = s.session_id""",
    "wire_events": f"""
SELECT t.capture_id, f.session_id, row_number() OVER (PARTITION BY t.capture_id ORDER BY number, part, k) - 1 AS seq, type, direction, {iso('make_timestamp(CAST(ts AS BIGINT) * 1000000)')} AS ts, CAST(number AS VARCHAR) AS packets, detail
FROM wire_timeline_rows t JOIN wire_flows f USING (capture_id)""",
    "wire_findings": f"SELECT {FLAT} FROM wire_finding_rows",
    "wire_graph": rewired_body(GRAPH_COUNTS),
    "wire_posture": rewired_body(POSTURE_BODIES["posture_snapshot"]),
}
BODIES["src_packets_split"] = BODIES["src_packets"]
