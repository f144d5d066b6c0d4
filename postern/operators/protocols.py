"""Application protocol: detection, conversation lines and timeline events.

Detection is built-in expressions over the head of each stream. Splitting a
stream into lines and walking a conversation are sequential within one TCP
connection; they run as ordered folds over sorted partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import labels
from postern.functions.columns import epoch_to_timestamp
from postern.operators.folds import fold_groups
from postern.operators.slices import sliced_row_number

C2S, S2C = "client_to_server", "server_to_client"
PROTOCOLS = ("smtp", "imap", "pop3")


# -- detection -------------------------------------------------------------------


def stream_heads(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The first bytes of every stream as latin-1 text (at most one detection window)."""
    rows = pieces.where(F.col("offset") < V.COMMAND_WINDOW)
    text = F.struct("offset", F.decode("data", "ISO-8859-1").alias("t"))
    listed = F.array_sort(F.collect_list(text))
    head = F.left(F.array_join(F.transform(listed, lambda s: s["t"]), ""), F.lit(V.COMMAND_WINDOW))
    return rows.groupBy(*keys).agg(head.alias("head"))


def detect_protocol(heads: DataFrame, keys: list[str]) -> DataFrame:
    """heads(keys, head_a, head_b, port_a, port_b) -> protocol, confidence, greeting side.

    Six candidates (protocol x server side) are scored; the best wins, and a tie
    between different protocols is unknown.
    """

    def candidate(protocol: str, side: str) -> Column:
        server, client = (F.coalesce(f"head_{s}", F.lit("")) for s in (side, "b" if side == "a" else "a"))
        greeting = F.left(server, F.lit(V.GREETING_WINDOW)).rlike(V.GREETING_PATTERNS[protocol])
        pattern = V.COMMAND_PATTERNS[protocol].replace("(?im)", "(?imd)")
        commands = F.size(F.array_distinct(F.regexp_extract_all(client, F.lit(pattern), F.lit(1))))
        banner = F.left(server, F.lit(V.BANNER_WINDOW)).rlike(V.BANNER_PATTERN) if protocol == "smtp" else F.lit(False)
        port = (labels.port_protocol("port_a") == protocol) | (labels.port_protocol("port_b") == protocol)
        points = (
            greeting.cast("int") * 2 + F.least(commands, F.lit(2)) + banner.cast("int") + F.coalesce(port, F.lit(False)).cast("int")
        )
        return F.struct(
            (-points).alias("order"), F.lit(PROTOCOLS.index(protocol) * 2 + (side == "b")).alias("n"), F.lit(protocol).alias("protocol"),
            F.when(greeting, F.lit(side)).alias("greeting_side"),
        )

    scored = F.array_sort(F.array(*[candidate(p, s) for p in PROTOCOLS for s in ("a", "b")]))
    best, second = F.col("c")[0], F.col("c")[1]
    rows = heads.withColumn("c", scored).withColumn("points", -best["order"])
    tie = (F.col("points") > 0) & (best["order"] == second["order"]) & (best["protocol"] != second["protocol"])
    confidence = (
        F.when(tie | (F.col("points") == 0), "unknown").when(F.col("points") >= 4, "high").when(F.col("points") >= 2, "medium").otherwise("low")
    )
    return rows.select(
        *keys, F.when(confidence.isin("medium", "high"), best["protocol"]).alias("protocol"), confidence.alias("confidence"),
        F.when(~tie, best["greeting_side"]).alias("greeting_side"),
    )


def infer_implicit(protocol: Column, confidence: Column, implicit: Column, version: Column, port: Column) -> tuple[Column, Column]:
    """Implicit-TLS port and a known version stand in for an unidentified protocol."""
    known = implicit & F.coalesce(version != "unknown", F.lit(False)) & protocol.isNull() & labels.port_protocol(port).isNotNull()
    return F.when(known, labels.port_protocol(port)).otherwise(protocol), F.when(known, "medium").otherwise(confidence)


# -- lines -------------------------------------------------------------------------

LINES = "line_offset bigint, line_end bigint, text string, first_packet bigint, last_packet bigint, at double, packets array<int>"
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class OpenLine:
    """The line being read: its shown text, its length, and the packets that carry it. Never its bytes."""

    def __init__(self, offset: int, carriers: list[tuple[int, int, float]]) -> None:
        self.offset, self.carriers = offset, carriers
        self.size, self.text, self.tail = 0, "", b""

    def add(self, data: bytes) -> None:
        if len(self.text) < V.MAX_LINE_LENGTH:
            self.text = (self.text + CONTROL.sub("", data.decode("latin-1")))[: V.MAX_LINE_LENGTH]
        self.size += len(data)
        self.tail = (self.tail + data)[-2:]

    def row(self) -> tuple:
        ending = 2 if self.tail == b"\r\n" else 1 if self.tail.endswith(b"\n") else 0
        last_byte = self.offset + max(1, self.size - ending) - 1
        packets = [number for k, (start, number, _) in enumerate(self.carriers) if not k or start <= last_byte]
        return self.offset, self.offset + self.size, self.text, min(packets), max(packets), self.carriers[0][2], packets


def split_lines(rows: Iterator[dict]) -> Iterator[tuple]:
    line = OpenLine(0, [])
    for row in rows:
        data, at = row["data"], 0
        carrier = (row["offset"], row["number"], row["ts"])
        line.carriers.append(carrier)
        while (newline := data.find(b"\n", at)) >= 0:
            line.add(data[at : newline + 1])
            yield line.row()
            at = newline + 1
            line = OpenLine(line.offset + line.size, [carrier] if at < len(data) else [])
        line.add(data[at:])
    if line.size:
        yield line.row()


def conversation_lines(pieces: DataFrame, keys: list[str], key_ddl: str) -> DataFrame:
    """CRLF or LF separated lines of every stream with the packets that carried them."""
    return fold_groups(pieces.select(*keys, "offset", "number", "ts", "data"), keys, ["offset"], split_lines, f"{key_ddl}, {LINES}")


def conversation_merge(lines: DataFrame, session: list[str]) -> DataFrame:
    """Both directions in wire order: by carrying packet, then offset."""
    return sliced_row_number(
        lines, session, F.call_function("div", F.col("first_packet"), F.lit(10_000)),
        [F.col("first_packet"), F.col("line_offset"), F.col("side")], "line_no",
    )


# -- events ------------------------------------------------------------------------

EVENTS = "order bigint, type string, side string, at double, first_packet bigint, last_packet bigint, detail map<string,string>, tls_start bigint, packets array<int>"


class Walk:
    """Collects the events of one conversation; protocol steps decide what a line means."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.closed = False
        self.greeted = False
        self.state: dict = {}

    def emit(self, kind: str, line: dict, tls_start: int | None = None, **detail: str) -> None:
        self.rows.append((kind, line["side"], line["at"], line["first_packet"], line["last_packet"], list(detail.items()), tls_start, line["packets"]))

    def request_tls(self, line: dict, **detail: str) -> None:
        self.emit("starttls_requested", line, line["line_end"], **detail)

    def accept_tls(self, line: dict, **detail: str) -> None:
        self.emit("starttls_response", line, line["line_end"], **detail)
        self.emit("tls_transition", line, phase=V.ENCRYPTED_STREAM_PHASE)
        self.closed = True


def _words(text: str) -> tuple[str, str]:
    parts = text.split(None, 1)
    return (parts[0].upper() if parts else "", parts[1].strip() if len(parts) > 1 else "")


def smtp_step(w: Walk, line: dict) -> None:
    text, s = line["text"], w.state
    word, rest = _words(text)
    if line["side"] == C2S:
        if s.get("body"):
            if text == ".":
                s["body"], s["delivered"] = False, True
        elif word == "STARTTLS":
            w.request_tls(line)
            s["asked"] = True
        elif word == "AUTH":
            w.emit("authentication", line, mechanism=rest.split(" ")[0][:64], credential_data="redacted")
        elif word == "MAIL":
            w.emit("mail_transaction_start", line, envelope=rest[:320])
        else:
            limit = {"RCPT": 320, "EHLO": 255, "HELO": 255}.get(word)
            detail = {"command": "RCPT TO" if word == "RCPT" else word[:32]}
            if limit:
                detail["argument"] = rest[:limit]
            w.emit("client_command", line, **detail)
        return
    code = text[:3]
    if s.pop("asked", False):
        w.accept_tls(line) if code == "220" else w.emit("server_response", line, code=code)
        return
    if s.get("body"):
        return
    fresh, w.greeted = not w.greeted, True
    if fresh and code == "220":
        w.emit("server_greeting", line, banner=text[:255])
    elif code == "250" and s.pop("delivered", False):
        w.emit("mail_transaction_complete", line, code="250")
    elif text.startswith("250-") and "STARTTLS" in text.upper():
        w.emit("starttls_advertised", line, capability="STARTTLS")
    else:
        if re.match(r"\d{3}[ -]", text):
            w.emit("server_response", line, code=code)
        s["body"] = code == "354"
        s["logout"] = s.get("logout", False) or code == "221"


def imap_step(w: Walk, line: dict) -> None:
    text, s = line["text"], w.state
    parts = text.split(None, 2)
    if line["side"] == C2S:
        if len(parts) < 2 or text[:1].isspace() or len(parts[0]) > 32 or len(parts[1]) > 32:
            return
        tag, word, rest = parts[0], parts[1].upper(), parts[2] if len(parts) > 2 else ""
        if word == "STARTTLS":
            w.request_tls(line, tag=tag)
            s["asked"] = tag
        elif word in ("LOGIN", "AUTHENTICATE"):
            w.emit("authentication", line, tag=tag, command=word, credential_data="redacted" if rest else "")
        else:
            w.emit("client_command", line, tag=tag, command=word, argument="redacted" if word in V.SENSITIVE_COMMANDS else rest[:512])
            s["logout"] = s.get("logout", False) or word == "LOGOUT"
        return
    fresh, w.greeted = not w.greeted, True
    if fresh and text.startswith("*"):
        w.emit("server_greeting", line, greeting=text[:255])
    elif text.startswith("* CAPABILITY") and "STARTTLS" in text.upper():
        w.emit("starttls_advertised", line, capability="STARTTLS")
    else:
        status = re.match(r"(\S{1,32})\s+(OK|NO|BAD)\b", text, re.IGNORECASE)
        if status:
            tag, verdict = status.group(1), status.group(2).upper()
            if verdict == "OK" and s.get("asked") == tag:
                s["asked"] = None
                w.accept_tls(line, tag=tag)
            else:
                w.emit("server_response", line, tag=tag, status=verdict)


def pop3_step(w: Walk, line: dict) -> None:
    text, s = line["text"], w.state
    word, _ = _words(text)
    listing = s.get("listing")  # None, "expected" or "open"
    if line["side"] == C2S:
        if listing:
            return
        if word in ("USER", "PASS"):
            w.emit("authentication", line, command=word, argument="redacted")
        elif word == "STLS":
            w.request_tls(line)
            s["asked"] = True
        else:
            w.emit("client_command", line, command=word[:32])
            if word in V.POP3_MULTILINE_COMMANDS:
                s["listing"] = "expected"
            s["logout"] = s.get("logout", False) or word == "QUIT"
        return
    good = text.startswith("+OK")
    if s.pop("asked", False):
        w.accept_tls(line) if good else w.emit("server_response", line, status="ERR")
    elif listing == "open":
        if text == ".":
            s["listing"] = None
        elif text.upper() == "STLS" and not s.get("advertised"):
            s["advertised"] = True
            w.emit("starttls_advertised", line, capability="STLS")
    elif listing == "expected" and good:
        s["listing"] = "open"
        w.emit("server_response", line, status="OK")
    else:
        s["listing"] = None
        fresh, w.greeted = not w.greeted, True
        if fresh:
            w.emit("server_greeting", line, greeting=text[:255])
        else:
            w.emit("server_response", line, status="OK" if good else "ERR")


STEPS: dict[str, Callable[[Walk, dict], None]] = {"smtp": smtp_step, "imap": imap_step, "pop3": pop3_step}


def walk_conversation(rows: Iterator[dict]) -> Iterator[tuple]:
    """Events leave line by line."""
    w, last, count = Walk(), None, 0
    for line in rows:
        if w.closed:
            break
        STEPS[line["protocol"]](w, line)
        for event in w.rows:
            yield count, *event
            count += 1
        w.rows.clear()
        last = line
    if w.state.get("logout") and last is not None:
        w.emit("logout_seen", last)
        yield count, *w.rows[0]


def conversation_events(lines: DataFrame, session: list[str], session_ddl: str) -> DataFrame:
    """lines(session, protocol, side, ...) -> timeline events; stops where the stream turns to ciphertext."""
    wanted = [*session, "protocol", "side", "line_offset", "line_end", "text", "first_packet", "last_packet", "at", "packets"]
    return fold_groups(lines.select(*wanted), session, ["first_packet", "line_offset"], walk_conversation, f"{session_ddl}, {EVENTS}")


def starttls_observation(events: DataFrame, session: list[str]) -> DataFrame:
    """Fold of the events into the STARTTLS observation and the ciphertext offsets."""
    kind = F.col("type")
    requested = kind == "starttls_requested"
    return events.groupBy(*session).agg(
        F.bool_or(kind == "starttls_advertised").alias("advertised"), F.bool_or(requested).alias("requested"),
        F.bool_or(kind == "starttls_response").alias("response_seen"),
        F.min(F.when(requested, F.col("first_packet"))).alias("packet_number"), F.min(F.when(requested, F.col("at"))).alias("requested_at"),
        F.max(F.when(requested, F.col("tls_start"))).alias("client_tls_start"), F.max(F.when(kind == "starttls_response", F.col("tls_start"))).alias("server_tls_start"),
    )


def connection_events(flows: DataFrame, logouts: DataFrame | None = None) -> DataFrame:
    """Established and closed events of every flow from its first and last packet."""
    flag = lambda p, bit: F.col(p)["tcp_flags"].bitwiseAND(bit) != 0
    at = lambda p: [F.col(p)["ts"].alias("ts"), F.col(p)["number"].alias("packet")]
    rows = flows if logouts is None else flows.join(logouts.withColumn("logout", F.lit(True)), "session_id", "left")
    logout = F.lit(False) if logouts is None else F.coalesce("logout", F.lit(False))
    opened = rows.select("session_id", F.lit("connection_established").alias("type"), *at("first"), F.when(flag("first", 2), "syn").otherwise("first packet").alias("basis"))
    basis = F.when(flag("last", 4), "rst").when(flag("last", 1), "fin").when(logout, "protocol")
    closed = rows.select("session_id", F.lit("connection_closed").alias("type"), *at("last"), basis.alias("basis")).where(F.col("basis").isNotNull())
    return opened.unionByName(closed)


def number_events(events: DataFrame, key: str, ts: str, packet: str, tie: str) -> DataFrame:
    """seq from 0 by (time with NULL last, packet, input order), one time slice (a second) at a time."""
    far = F.lit(9_000_000_000_000)
    seconds = F.coalesce(F.floor(F.col(ts).cast("double")), far)
    order = [F.col(ts).asc_nulls_last(), F.coalesce(F.col(packet), F.lit(1 << 30)), F.col(tie)]
    return sliced_row_number(events, [key], seconds, order, "n").withColumn("seq", F.col("n") - 1).drop("n")


def session_timeline(events: DataFrame, flows: DataFrame) -> DataFrame:
    """Conversation and connection events of every session as numbered timeline rows, in the stored form."""
    spoken = events.where(F.col("type") != "logout_seen").select(
        "session_id", "type", F.col("side").alias("direction"), F.col("at").alias("ts"), "packets", "detail", F.lit(1).alias("part"), F.col("order")
    )
    logouts = events.where(F.col("type") == "logout_seen").select("session_id").distinct()
    linked = connection_events(flows, logouts)
    outer = linked.select(
        "session_id", "type", F.lit("unknown").alias("direction"), "ts", F.array(F.col("packet").cast("int")).alias("packets"),
        F.create_map(F.lit("basis"), F.col("basis")).alias("detail"), F.when(F.col("type") == "connection_closed", 2).otherwise(0).alias("part"), F.lit(0).cast("bigint").alias("order"),
    )
    rows = spoken.unionByName(outer).withColumns({"packet": F.array_min("packets"), "tie": F.struct("part", "order")})
    numbered = number_events(rows, "session_id", "ts", "packet", "tie")
    return numbered.join(flows.select("session_id", "capture_id"), "session_id").select(
        "capture_id", "session_id", "seq", "type", "direction", epoch_to_timestamp("ts").alias("ts"), F.col("packets").alias("packet_numbers"), "detail"
    )
