"""Queries from bytes: packets, flows, streams, protocols, TLS, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern.functions import ids, labels
from postern.functions.columns import iso_text
from postern.operators import flows as FL
from postern.operators import graph, posture, rules
from postern.operators import protocols as P
from postern.operators import tls as T
from postern.plans.base import query
from postern.plans.findings_plans import flat
from postern.sources import captures as C


@query("src_captures")
def src_captures(w):
    return C.identify(w.capture_files).groupBy("format").agg(F.count("*").alias("captures"), F.sum("size_bytes").alias("bytes"))


def _shown(packets):
    return packets.select(
        "capture_id", "number", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq",
        F.col("captured_len").cast("bigint").alias("captured_len"), F.md5("payload").alias("payload_md5"),
    )


@query("src_packets")
def src_packets(w):
    return _shown(w.packets)


@query("src_packets_split")
def src_packets_split(w):
    """The same packets from containers that are cut into parts of 256 bytes and read part by part."""
    named = w.capture_files.select(F.substring_index("path", ".", 1).alias("capture_id"), "content")
    return _shown(C.tcp_packets(C.parse_packets(named, part_bytes=256)))


@query("packet_skip_coverage")
def packet_skip_coverage(w):
    """Containers cut short and re-typed: every skipped record is counted by reason."""
    n = F.pmod(F.length("content"), F.lit(2))
    broken = F.when(n == 0, F.expr("substring(content, 1, length(content) - 3)")).otherwise(
        F.concat(F.expr("substring(content, 1, 52)"), F.unhex(F.lit("0806")), F.expr("substring(content, 55)"))
    )
    files = w.capture_files.select(F.col("path").alias("capture_id"), broken.alias("content"))
    return C.skip_coverage(C.parse_packets(files)).groupBy("reason").agg(F.count("*").alias("captures"), F.sum("n").alias("packets"))


@query("capture_packet_metadata")
def capture_packet_metadata(w):
    m = C.packet_metadata(w.packets)
    return m.withColumns({c: iso_text(c) for c in ("capture_started_at", "capture_ended_at")})


@query("tcp_flags_label")
def tcp_flags_label(w):
    return w.packets.select("capture_id", "number", labels.tcp_flags_label("tcp_flags").alias("flags"))


@query("flow_key")
def flow_key(w):
    return FL.with_flow(w.packets).select("capture_id", "number", "flow", "direction")


@query("session_id")
def session_id(w):
    return FL.with_flow(w.packets).select("capture_id", ids.session_id("capture_id", "flow").alias("session_id")).distinct()


@query("flow_build")
def flow_build(w):
    return FL.build_flows(w.packets).select("capture_id", "session_id", "flow", "packet_count", "packets_a", "packets_b")


@query("flow_first_last")
def flow_first_last(w):
    f = FL.build_flows(w.packets)
    return f.select("session_id", F.col("first.number").alias("first_packet"), F.col("last.number").alias("last_packet"), (F.col("last.ts") - F.col("first.ts")).alias("duration"))


@query("flow_orientation")
def flow_orientation(w):
    return FL.flow_orientation(w.packets).select("capture_id", "flow", "server_side", "basis")


@query("seq_normalize")
def seq_normalize(w):
    n = FL.normalize_sequence(w.packets).where("start IS NOT NULL")
    return n.select("capture_id", "direction", "number", "start", "end", "stale")


@query("stream_coverage")
def stream_coverage(w):
    """Coverage of line item segments: gaps and overlaps of many streams."""
    return FL.stream_coverage(w.line_segments, ["flow"])


@query("stream_completeness")
def stream_completeness(w):
    coverage = FL.stream_coverage(w.line_segments, ["flow"]).join(w.line_segments.groupBy("flow").agg(F.bool_or("fin").alias("fin")), "flow")
    complete, reason = FL.completeness("gap_count", "gap_bytes", "fin")
    return coverage.select("flow", complete.alias("complete"), reason.alias("reason"))


@query("stream_dup_counts")
def stream_dup_counts(w):
    pieces = FL.stream_pieces(w.line_segments.withColumn("stale", F.lit(False)), ["flow"], "flow bigint")
    return pieces.select("flow", "duplicate", "retransmitted", "segments").distinct()


@query("stream_bytes")
def stream_bytes(w):
    """Length and digest of the reconstructed bytes of every direction; the dialogues are short, so their bytes meet here."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "data")))
    return w.streams.pieces.groupBy("capture_id", "direction").agg(
        F.sum(F.length("data")).cast("bigint").alias("bytes"), F.max("duplicate").alias("duplicate"), F.max("retransmitted").alias("retransmitted"),
        F.sha2(F.array_join(F.transform(parts, lambda s: F.hex(s["data"])), ""), 256).alias("hex_sha256"),
    )


@query("protocol_detect")
def protocol_detect(w):
    return w.reconstruction.roles.select("capture_id", "protocol", "confidence", "server_side")


@query("port_protocol")
def port_protocol(w):
    return w.packets.select("dst_port").distinct().select("dst_port", labels.port_protocol("dst_port").alias("protocol"), labels.implicit_tls_port("dst_port").alias("implicit"))


@query("conversation_lines")
def conversation_lines(w):
    return w.reconstruction.lines.where(F.col("side") == P.S2C).groupBy("capture_id").agg(F.min_by("text", "line_offset").alias("greeting"))


@query("conversation_merge")
def conversation_merge(w):
    """Every line up to where a conversation turns to ciphertext."""
    r = w.reconstruction
    m = P.conversation_merge(r.lines, ["capture_id", "session_id"])
    turned = r.starttls.select("session_id", "client_tls_start", "server_tls_start")
    limit = F.when(F.col("side") == P.C2S, F.col("client_tls_start")).otherwise(F.col("server_tls_start"))
    plain = m.join(turned, "session_id", "left").where(F.col("line_end") <= F.coalesce(F.when(F.col("server_tls_start").isNotNull(), limit), F.lit(1 << 62)))
    return plain.select("capture_id", "line_no", "side", "line_offset", "line_end", "text", F.array_join(F.col("packets").cast("array<string>"), ",").alias("packets"))


def _events(name: str, protocol: str) -> None:
    @query(name)
    def run(w):
        r = w.reconstruction
        spoken = r.roles.where(F.col("protocol") == protocol).select("session_id")
        e = r.events.join(spoken, "session_id", "left_semi").where(F.col("type") != "logout_seen")
        return e.groupBy("capture_id", "type").agg(F.count("*").alias("n"))


for _name, _protocol in (("smtp_events", "smtp"), ("imap_events", "imap"), ("pop3_events", "pop3")):
    _events(_name, _protocol)


@query("connection_events")
def connection_events(w):
    r = w.reconstruction
    logouts = r.events.where(F.col("type") == "logout_seen").select("session_id").distinct()
    e = P.connection_events(r.flows, logouts)
    return e.join(r.flows.select("session_id", "capture_id"), "session_id").select("capture_id", "type", "packet", "basis")


@query("event_numbering")
def event_numbering(w):
    """Timeline numbers per user over the whole events table."""
    e = w.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.number_events(e.withColumn("packet", F.lit(None).cast("bigint")), "user_id", "ts", "packet", "event_id").select("user_id", "event_id", "seq")


@query("starttls_observation")
def starttls_observation(w):
    r = w.reconstruction
    return r.sessions.where("advertised OR requested OR response_seen").select("capture_id", "advertised", "requested", "response_seen")


@query("tls_hello_facts")
def tls_hello_facts(w):
    """Hellos with extension values, offered suites, the packets that carried them, presented certificates and warnings."""
    shown = F.array_join(F.transform("extensions", lambda e: F.concat_ws("=", e["name"], e["length"].cast("string"), e["value"])), ";")
    return w.reconstruction.tls.where("started IS NOT NULL").select(
        "capture_id", "client_seen", "server_seen", "selected", "sni", "alpn", "progressed", shown.alias("extensions"), F.array_join(F.transform("offered", lambda c: c.cast("string")), ",").alias("offered"),
        F.array_join(F.col("client_hello_packets").cast("array<string>"), ",").alias("client_packets"), F.array_join(F.col("server_hello_packets").cast("array<string>"), ",").alias("server_packets"),
        F.array_join("fingerprints", ",").alias("fingerprints"), F.array_join("warnings", ";").alias("warnings"),
    )


@query("negotiated_version")
def negotiated_version(w):
    f = w.reconstruction.tls
    code = T.negotiated_version(F.col("chosen_version"), F.col("server_version"), F.col("offered_versions"), F.col("client_version"))
    return f.select("capture_id", labels.tls_version_name(code).alias("tls_version"))


@query("handshake_complete")
def handshake_complete(w):
    complete, reason = T.handshake_complete(F.col("client_seen"), F.col("server_seen"), F.col("progressed"))
    return w.reconstruction.tls.select("capture_id", complete.alias("handshake_complete"), reason.alias("reason"))


@query("implicit_protocol_inference")
def implicit_protocol_inference(w):
    return w.reconstruction.sessions.where("implicit_tls").select("capture_id", "protocol", "confidence", "orientation")


@query("session_build")
def session_build(w):
    s = w.reconstruction.sessions
    return s.select(
        "capture_id", "client_ip", "client_port", "server_ip", "server_port", "protocol", "orientation", "implicit_tls", "complete", "completeness_reason", "advertised", "requested",
        "response_seen", "tls_version", "cipher_suite", "key_exchange", F.col("sni_server_name").alias("sni"), "handshake_complete", "packet_count", "gap_count", "retransmissions",
        iso_text("started_at").alias("started_at"),
    )


@query("wire_events")
def wire_events(w):
    """The numbered timeline of every rebuilt session: order, direction, packets and details."""
    detail = F.array_join(F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return w.wire_timeline.select(
        "capture_id", "session_id", "seq", "type", "direction", iso_text("ts").alias("ts"), F.array_join(F.col("packet_numbers").cast("array<string>"), ",").alias("packets"), detail.alias("detail"),
    )


@query("wire_findings")
def wire_findings(w):
    """All rules over the sessions rebuilt from packets."""
    return flat(rules.evaluate(w.wire_sessions, w.wire_timeline, w.policy))


@query("wire_posture")
def wire_posture(w):
    """Posture of every capture, from its packets."""
    captures = w.wire_sessions.select("capture_id").distinct()
    return posture.posture_snapshot(captures, w.wire_hits, w.policy).withColumn("generated_at", iso_text("generated_at"))


@query("wire_graph")
def wire_graph(w):
    """Evidence graph of the rebuilt sessions: node and edge counts by type of every capture."""
    s = w.wire_sessions
    findings = rules.evaluate(s, w.wire_timeline, w.policy)
    none = w.anomalies.where("FALSE")
    factors = posture.posture_factors(w.wire_hits)
    nodes = graph.graph_nodes(s, findings, w.wire_timeline, none, factors).groupBy("capture_id", F.col("node_type").alias("type")).agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    edges = graph.graph_edges(s, findings, w.wire_timeline, none, factors).groupBy("capture_id", F.col("edge_type").alias("type")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edge"))
    return nodes.unionByName(edges)
