"""Packet captures built by Spark from the session numbers, as input of the byte-level jobs.

One small classic pcap container per session: handshake, protocol dialogue, TLS
hellos and termination, following the session's profile. ``STEPS`` are plain SQL
expressions (direction, condition, payload in hex) that mean the same in Spark
and in the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.functions.fixed_values import TLS_VERSION_CODES
from postern.sources.testdata import PROFILES

CRLF = "chr(13), chr(10)"
ADV, REQ, RESP = "p IN (0, 2, 3, 4, 5, 6, 8, 10, 11)", "p IN (0, 2, 3, 5, 6, 8, 10, 11)", "p IN (0, 2, 3, 6, 8, 10, 11)"
LOGIN = "(p = 9 AND h % 2 = 1)"
PLAIN = "NOT implicit_tls"
TLS = f"(implicit_tls OR {RESP})"


def _by_protocol(imap: str, pop3: str, smtp: str) -> str:
    return f"hex(CASE protocol WHEN 'imap' THEN concat({imap}) WHEN 'pop3' THEN concat({pop3}) ELSE concat({smtp}) END)"


def _profile_hex(position_value) -> str:
    return "CASE p " + " ".join(f"WHEN {row[0]} THEN {position_value(row)}" for row in PROFILES if row[1]) + " END"


VERSION_CODE = {name: code for code, name in TLS_VERSION_CODES.items()}
LEGACY = _profile_hex(lambda r: f"'{min(VERSION_CODE[r[1]], 0x0303):04X}'")
SUITE = _profile_hex(lambda r: f"'{r[2]:04X}'")
RANDOM = "repeat('AB', 32)"
SNI = "hex(concat('mail', CAST(host AS STRING), '.example.org'))"
NAME_LENGTH = "18"  # mailNN.example.org
SERVER_NAME = f"concat('0000', printf('%04X', {NAME_LENGTH} + 5), printf('%04X', {NAME_LENGTH} + 3), '00', printf('%04X', {NAME_LENGTH}), {SNI})"
ALPN = "'0010000C000A04696D617004706F7033'"
CLIENT_EXTENSIONS = f"concat({SERVER_NAME}, CASE WHEN p = 1 THEN concat('002B0003020304', {ALPN}) ELSE '' END)"
CLIENT_BODY = f"concat({LEGACY}, {RANDOM}, '00', '0004', {SUITE}, '1301', '0100', printf('%04X', CAST(length({CLIENT_EXTENSIONS}) / 2 AS INT)), {CLIENT_EXTENSIONS})"
SERVER_EXTENSIONS = "CASE WHEN p = 1 THEN '002B00020304' ELSE '' END"
SERVER_BODY = f"concat({LEGACY}, {RANDOM}, '00', {SUITE}, '00', printf('%04X', CAST(length({SERVER_EXTENSIONS}) / 2 AS INT)), {SERVER_EXTENSIONS})"


def _record(kind: str, body: str, tail: str = "''") -> str:
    size = f"CAST(length({body}) / 2 AS INT)"
    return f"concat('160301', printf('%04X', {size} + 4), '{kind}', printf('%06X', {size}), {body}, {tail})"


# A session's certificates, whose bytes have the fingerprints of the evidence tables.
LEAF, ISSUER = "hex(concat('cert', CAST(cert_no AS STRING)))", "hex(concat('issuer', CAST(cert_no % 3 AS STRING)))"


def _sized(body: str) -> str:
    return f"concat(printf('%06X', CAST(length({body}) / 2 AS INT)), {body})"


CHAIN = f"CASE WHEN cert_no % 2 = 0 OR cert_no = 11 THEN concat({_sized(LEAF)}, {_sized(ISSUER)}) ELSE {_sized(LEAF)} END"
CERTIFICATE = f"CASE WHEN cert_no IS NOT NULL THEN {_record('0B', _sized(CHAIN))} ELSE '' END"
CCS = "CASE WHEN p <> 8 THEN '140303000101' ELSE '' END"
STEPS = (
    ("s", PLAIN, _by_protocol(f"'* OK ready', {CRLF}", f"'+OK ready', {CRLF}", f"'220 mail ESMTP ready', {CRLF}")),
    ("c", PLAIN, _by_protocol(f"'a1 CAPABILITY', {CRLF}", f"'CAPA', {CRLF}", f"'EHLO client.example.org', {CRLF}")),
    (
        "s", PLAIN,
        _by_protocol(
            f"'* CAPABILITY IMAP4rev1', CASE WHEN {ADV} THEN ' STARTTLS' ELSE '' END, {CRLF}, 'a1 OK done', {CRLF}",
            f"'+OK caps', {CRLF}, CASE WHEN {ADV} THEN concat('STLS', {CRLF}) ELSE '' END, 'UIDL', {CRLF}, '.', {CRLF}",
            f"'250-mail.example.org', {CRLF}, CASE WHEN {ADV} THEN concat('250-STARTTLS', {CRLF}) ELSE '' END, '250 HELP', {CRLF}",
        ),
    ),
    (
        "c", PLAIN,
        _by_protocol(
            f"CASE WHEN {REQ} THEN 'a2 STARTTLS' WHEN {LOGIN} THEN 'a2 LOGIN user pass' ELSE 'a2 NOOP' END, {CRLF}",
            f"CASE WHEN {REQ} THEN 'STLS' WHEN {LOGIN} THEN concat('USER bob', {CRLF}, 'PASS x') ELSE 'STAT' END, {CRLF}",
            f"CASE WHEN {REQ} THEN 'STARTTLS' WHEN {LOGIN} THEN 'AUTH PLAIN AGEAYg==' ELSE 'MAIL FROM:<a@example.org>' END, {CRLF}",
        ),
    ),
    (
        "s", PLAIN,
        _by_protocol(
            f"CASE WHEN {RESP} THEN 'a2 OK begin' WHEN {REQ} THEN 'a2 NO refused' ELSE 'a2 OK fine' END, {CRLF}",
            f"CASE WHEN {RESP} THEN '+OK begin' WHEN {REQ} THEN '-ERR no' ELSE '+OK fine' END, {CRLF}",
            f"CASE WHEN {RESP} THEN '220 go ahead' WHEN {REQ} THEN '454 not available' WHEN {LOGIN} THEN '235 ok' ELSE '250 ok' END, {CRLF}",
        ),
    ),
    ("c", TLS, _record("01", CLIENT_BODY, CCS)),
    ("s", TLS, _record("02", SERVER_BODY, f"{CERTIFICATE}, {CCS}")),
    ("c", f"{PLAIN} AND NOT ({RESP})", _by_protocol(f"'a3 LOGOUT', {CRLF}", f"'QUIT', {CRLF}", f"'QUIT', {CRLF}")),
    ("s", f"{PLAIN} AND NOT ({RESP})", _by_protocol(f"'a3 OK bye', {CRLF}", f"'+OK bye', {CRLF}", f"'221 bye', {CRLF}")),
)
CLIENT_ISN = "4294967200 + h % 90"  # wraps around 2^32 within the dialogue
SERVER_ISN = "h * 17 % 1000000"
RETRANSMIT = "h % 5 = 0"  # the client's first data packet is sent twice


def _ip_hex(column: str):
    octets = F.transform(F.split(F.col(column), r"\."), lambda o: F.format_string("%02X", o.cast("int")))
    return F.array_join(octets, "")


def capture_files(session_numbers: DataFrame) -> DataFrame:
    """(path, content): one pcap container per session, big-endian microseconds, Ethernet."""
    flags = {"syn": "02", "synack": "12", "data": "18", "fin": "11"}
    named = lambda text: text.replace(CLIENT_BODY, "client_body").replace(SERVER_BODY, "server_body").replace(CERTIFICATE, "certificate")
    step = lambda d, cond, payload: f"CASE WHEN {cond} THEN named_struct('d', '{d}', 'f', '{flags['data']}', 'x', {named(payload)}) END"
    dialogue = ", ".join(step(d, cond, payload) for d, cond, payload in STEPS)
    steps = F.expr(f"array_compact(array({dialogue}))")
    bare = lambda d, kind, cond="TRUE": f"CASE WHEN {cond} THEN named_struct('d', '{d}', 'f', '{flags[kind]}', 'x', '', 'seq', {{}}) END"
    # Long texts that STEPS repeat are built once a session; numbers are written by functions that Spark compiles.
    n = session_numbers.withColumns({"client_extensions": F.expr(CLIENT_EXTENSIONS), "certificates": F.expr(_sized(CHAIN))})
    n = n.withColumns({
        "client_body": F.expr(CLIENT_BODY.replace(CLIENT_EXTENSIONS, "client_extensions")), "server_body": F.expr(SERVER_BODY),
        "certificate": F.expr(CERTIFICATE.replace(_sized(CHAIN), "certificates")),
    })
    n = n.withColumn("steps", steps)
    number = lambda digits, value: f"coalesce(lpad(hex({value}), {digits}, '0'), 'null')"
    # Relative offset of a step: bytes sent before it in its own direction.
    placed = F.expr(
        f"""transform(steps, (s, i) -> named_struct('d', s.d, 'f', s.f, 'x', s.x, 'seq',
            CASE WHEN s.d = 'c' THEN {CLIENT_ISN} ELSE {SERVER_ISN} END + 1 +
            aggregate(slice(steps, 1, i), 0L, (a, e) -> a + CASE WHEN e.d = s.d THEN length(e.x) div 2 ELSE 0 END)))"""
    )
    n = n.withColumn("placed", placed)
    again = F.expr(f"CASE WHEN {RETRANSMIT} THEN filter(placed, s -> s.d = 'c')[0] END")
    fin_seq = F.expr(f"{CLIENT_ISN} + 1 + aggregate(steps, 0L, (a, e) -> a + CASE WHEN e.d = 'c' THEN length(e.x) div 2 ELSE 0 END)")
    n = n.withColumns({"again": again, "fin_seq": fin_seq})
    packets = F.expr(
        f"""array_compact(concat(array({bare('c', 'syn').format(CLIENT_ISN)}, {bare('s', 'synack').format(SERVER_ISN)}), placed,
            array(again), array({bare('c', 'fin', 'complete').format('fin_seq')})))"""
    )
    client_ip, server_ip = _ip_hex("client_ip"), _ip_hex("server_ip")
    n = n.withColumns({"packets": packets, "ch": client_ip, "sh": server_ip, "cp": F.expr(number(4, "client_port")), "sp": F.expr(number(4, "server_port")), "base": F.unix_seconds("started_at")})
    frames = F.expr(
        f"""transform(packets, (k, i) -> concat(
            {number(8, 'base + i')}, '00000000', {number(8, '54 + length(k.x) div 2')}, {number(8, '54 + length(k.x) div 2')},
            repeat('00', 12), '0800', '4500', {number(4, '40 + length(k.x) div 2')}, '00000000', '4006', '0000',
            CASE WHEN k.d = 'c' THEN concat(ch, sh, cp, sp) ELSE concat(sh, ch, sp, cp) END,
            {number(8, 'pmod(k.seq, 4294967296L)')}, '00000000', '50', k.f, 'FFFF', '00000000', k.x))"""
    )
    header = "A1B2C3D4" + "00020004" + "00000000" + "00000000" + "00040000" + "00000001"
    content = F.unhex(F.concat(F.lit(header), F.array_join(frames, "")))
    return n.select(F.concat("session_id", F.lit(".pcap")).alias("path"), content.alias("content"))
