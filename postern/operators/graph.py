"""Evidence graph per capture: nodes, edges, traversal, pivots and session context.

Session rows are exploded once into their nodes and once into their edges;
duplicates collapse in a partial aggregate on the primary key. Three points
differ from a naive derivation on purpose: every server endpoint gets a node,
shared-certificate edges name the shared certificate, and anomaly nodes and
edges are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import ids
from postern.functions.columns import cents_text, iso_text, memo
from postern.functions.normalize import strip_sensitive_keys
from postern.session import stored_by

NODE = ["capture_id", "node_id", "node_type", "label", "source_id", "metadata"]
EDGE = ["capture_id", "source_node_id", "target_node_id", "edge_type", "basis"]

# A node id is a prefix that names the node's type and 12 hexadecimal digits. Rows are told apart by
# (type, digits as a number), which is the same as by their texts; the texts are put together behind that.
NODE_TYPES = (
    ("capture", "capture_"), ("session", "snode_"), ("endpoint", "endpoint_"), ("host", "host_"), ("protocol", "protocol_"), ("tls_handshake", "tlshk_"),
    ("tls_configuration", "tlscfg_"), ("certificate", "gcert_"), ("finding", "fnode_"), ("timeline_event", "event_"), ("anomaly", "anode_"), ("posture_factor", "pfactor_"),
)
EDGE_TYPES = (
    ("capture_contains_host", "host observed in capture", "capture", "host"),
    ("host_owns_endpoint", "server endpoint on host", "host", "endpoint"),
    ("endpoint_participates_in_session", "client endpoint", "endpoint", "session"),
    ("endpoint_participates_in_session", "server endpoint", "endpoint", "session"),
    ("session_connects_to_endpoint", "client endpoint", "session", "endpoint"),
    ("session_connects_to_endpoint", "server endpoint", "session", "endpoint"),
    ("session_uses_protocol", "protocol identified", "session", "protocol"),
    ("session_has_tls_handshake", "TLS handshake reconstructed", "session", "tls_handshake"),
    ("session_uses_tls_config", "same TLS configuration", "session", "tls_configuration"),
    ("tls_config_seen_in_host", "same TLS configuration on host", "tls_configuration", "host"),
    ("tls_contains_certificate", "certificate chain", "tls_handshake", "certificate"),
    ("session_produced_finding", "rule-based finding", "session", "finding"),
    ("finding_affects_session", "finding affects session", "finding", "session"),
    ("finding_affects_host", "finding affects host", "finding", "host"),
    ("event_belongs_to_session", "timeline event", "timeline_event", "session"),
    ("session_has_anomaly", "statistical deviation", "session", "anomaly"),
    ("anomaly_affects_session", "statistical deviation", "anomaly", "session"),
    ("capture_has_posture_factor", "posture factor", "capture", "posture_factor"),
    ("tls_contains_certificate", "certificate fingerprint match", "session", "certificate"),
)
_PREFIX = dict(NODE_TYPES)
_NODE_KIND = {name: kind for kind, (name, _) in enumerate(NODE_TYPES)}
_EDGE_KIND = {edge[:2]: kind for kind, edge in enumerate(EDGE_TYPES)}


def _number(node_id: Column) -> Column:
    """The last 12 hexadecimal digits of a node id as a number."""
    return F.conv(F.right(node_id, F.lit(12)), 16, 10).cast("bigint")


def _text(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lpad(F.lower(F.hex(number)), 12, "0"))


def _of(kind: str, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(kind) + 1)


def _node(node_id: Column, kind: str, label: Column, source: Column, metadata: Column | None = None) -> Column:
    return F.struct(
        F.lit(_NODE_KIND[kind]).alias("kind"), _number(node_id).alias("n"), label.alias("label"), source.alias("source_id"),
        (metadata if metadata is not None else F.lit("")).alias("metadata"),
    )


def _edge(source: Column, target: Column, kind: str, basis: str) -> Column:
    """source, target: numbers of node ids."""
    return F.struct(F.lit(_EDGE_KIND[kind, basis]).alias("kind"), source.alias("s"), target.alias("t"))


def _hs(name: str) -> Column:
    return F.col(f"handshake.{name}")


def config_fingerprint() -> Column:
    return ids.tls_config_fingerprint(_hs("tls_version"), _hs("cipher_suite"), _hs("key_exchange"))


def _fingerprint(c: Column) -> Column:
    return F.coalesce(c["fingerprint_sha256"], c["certificate_id"])


def _address(ip: str, port: str) -> Column:
    return F.concat_ws(":", F.col(ip), F.col(port).cast("string"))


def _session_nodes() -> Column:
    tls = _hs("tls_version")
    own = F.array(
        _node(ids.session_node("session_id"), "session", F.col("session_id"), F.col("session_id"), F.coalesce("protocol", F.lit(""))),
        _node(ids.endpoint_node("client_ip", "client_port"), "endpoint", _address("client_ip", "client_port"), _address("client_ip", "client_port")),
        _node(ids.endpoint_node("server_ip", "server_port"), "endpoint", _address("server_ip", "server_port"), _address("server_ip", "server_port")),
        _node(ids.host_node("server_ip"), "host", F.col("server_ip"), F.col("server_ip")),
        F.when(F.col("protocol").isNotNull(), _node(ids.protocol_node("protocol"), "protocol", F.upper("protocol"), F.col("protocol"))),
        F.when(
            F.col("handshake").isNotNull(),
            _node(ids.handshake_node("session_id"), "tls_handshake", F.concat(F.lit("TLS "), tls), _hs("handshake_id"), F.coalesce(_hs("cipher_suite"), F.lit(""))),
        ),
        F.when(
            F.col("handshake").isNotNull(),
            _node(ids.tls_config_node(config_fingerprint()), "tls_configuration", F.concat(F.lit("TLS "), tls), config_fingerprint(), F.coalesce(_hs("cipher_suite"), F.lit(""))),
        ),
    )
    certificates = F.when(
        F.col("handshake").isNotNull(),
        F.transform("certificates", lambda c: _node(ids.certificate_node(_fingerprint(c)), "certificate", c["subject"], c["certificate_id"], c["issuer"])),
    )
    return F.array_compact(F.concat(own, F.coalesce(certificates, F.array())))


def _session_ends() -> list[Column]:
    """The nodes a session's edges join, each worked out once."""
    known = F.col("handshake").isNotNull()
    return [
        _number(ids.capture_node("capture_id")).alias("capture"), _number(ids.session_node("session_id")).alias("session"), _number(ids.host_node("server_ip")).alias("host"),
        _number(ids.endpoint_node("client_ip", "client_port")).alias("client"), _number(ids.endpoint_node("server_ip", "server_port")).alias("server"),
        F.when(F.col("protocol").isNotNull(), _number(ids.protocol_node("protocol"))).alias("protocol"),
        F.when(known, _number(ids.handshake_node("session_id"))).alias("handshake"), F.when(known, _number(ids.tls_config_node(config_fingerprint()))).alias("config"),
        F.when(known, F.transform("certificates", lambda c: _number(ids.certificate_node(_fingerprint(c))))).alias("certificates"),
    ]


def _session_edges() -> Column:
    capture, session, host, client, server, handshake, config = (F.col(c) for c in ("capture", "session", "host", "client", "server", "handshake", "config"))
    with_tls = lambda e: F.when(handshake.isNotNull(), e)
    own = F.array(
        _edge(capture, host, "capture_contains_host", "host observed in capture"),
        _edge(host, server, "host_owns_endpoint", "server endpoint on host"),
        _edge(client, session, "endpoint_participates_in_session", "client endpoint"),
        _edge(server, session, "endpoint_participates_in_session", "server endpoint"),
        _edge(session, client, "session_connects_to_endpoint", "client endpoint"),
        _edge(session, server, "session_connects_to_endpoint", "server endpoint"),
        F.when(F.col("protocol").isNotNull(), _edge(session, F.col("protocol"), "session_uses_protocol", "protocol identified")),
        with_tls(_edge(session, handshake, "session_has_tls_handshake", "TLS handshake reconstructed")),
        with_tls(_edge(session, config, "session_uses_tls_config", "same TLS configuration")),
        with_tls(_edge(config, host, "tls_config_seen_in_host", "same TLS configuration on host")),
    )
    certificates = F.transform("certificates", lambda c: _edge(handshake, c, "tls_contains_certificate", "certificate chain"))
    return F.array_compact(F.concat(own, F.coalesce(certificates, F.array())))


def _node_rows(sessions, findings, events, anomalies, factors) -> DataFrame:
    exploded = lambda df, nodes: df.select("capture_id", F.explode(nodes).alias("n")).select("capture_id", "n.*")
    one = lambda df, node: df.select("capture_id", node.alias("n")).select("capture_id", "n.*")
    captures = sessions.select("capture_id").distinct()
    parts = [
        one(captures, _node(ids.capture_node("capture_id"), "capture", F.concat(F.lit("Capture "), "capture_id"), F.col("capture_id"))),
        exploded(sessions, memo("graph_nodes", _session_nodes)),
        one(findings, _node(ids.finding_node("finding_id"), "finding", F.col("title"), F.col("finding_id"), F.col("severity"))),
        one(events, _node(ids.event_node("session_id", "seq"), "timeline_event", F.col("type"), F.concat_ws("#", "session_id", F.col("seq").cast("string")), F.col("direction"))),
        one(
            anomalies.where(F.col("band").isin(*V.FLAGGED_BANDS)),
            _node(ids.anomaly_node("anomaly_id"), "anomaly", F.col("band"), F.col("anomaly_id"), F.col("score").cast("string")),
        ),
        one(
            factors.where(F.col("contribution_cents") > 0),
            _node(ids.posture_node("factor", "capture_id"), "posture_factor", F.concat("label", F.lit(": "), "status"), F.col("factor"), cents_text(F.col("contribution_cents"))),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def graph_nodes(sessions, findings, events, anomalies, factors) -> DataFrame:
    """Distinct nodes per capture; the smallest label wins should one id carry several."""
    first = F.min(F.struct("label", "source_id", "metadata")).alias("first")
    rows = _node_rows(sessions, findings, events, anomalies, factors).groupBy("n", "kind", "capture_id").agg(first)
    return node_names(rows.select("capture_id", "kind", "n", "first.*"))


def node_keys(sessions, findings, events, anomalies, factors) -> DataFrame:
    """The nodes of ``graph_nodes`` without their texts, as (capture_id, kind, n)."""
    return _node_rows(sessions, findings, events, anomalies, factors).select("capture_id", "kind", "n").distinct()


def node_names(keys: DataFrame) -> DataFrame:
    """(capture_id, kind, n, ...) -> (capture_id, node_id, node_type, ...)."""
    rest = [c for c in keys.columns if c not in ("capture_id", "kind", "n")]
    names, prefixes = zip(*NODE_TYPES, strict=True)
    return keys.select("capture_id", _text(_of("kind", prefixes), F.col("n")).alias("node_id"), _of("kind", names).alias("node_type"), *rest)


def shared_certificate_edges(sessions: DataFrame) -> DataFrame:
    """session -> certificate for certificates presented in two or more sessions of a capture, as keys."""
    uses = sessions.select("capture_id", "session_id", F.explode("certificates").alias("c")).select(
        "capture_id", _number(ids.session_node("session_id")).alias("s"), _fingerprint(F.col("c")).alias("fingerprint")
    )
    shared = uses.groupBy("capture_id", "fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("capture_id", "fingerprint")
    return uses.join(shared, ["capture_id", "fingerprint"]).select(
        "capture_id", F.lit(_EDGE_KIND["tls_contains_certificate", "certificate fingerprint match"]).alias("kind"), "s",
        _number(ids.certificate_node("fingerprint")).alias("t"),
    )


def edge_keys(sessions, findings, events, anomalies, factors) -> DataFrame:
    """Distinct directed edges per capture as (capture_id, kind, s, t): kind of edge, numbers of its ends."""
    exploded = lambda df, edges: df.select("capture_id", F.explode(edges).alias("e")).select("capture_id", "e.*")
    finding, session, anomaly = F.col("finding"), F.col("session"), F.col("anomaly")
    named = lambda df, **ends: df.select("capture_id", *[_number(e).alias(n) for n, e in ends.items()])
    own = ids.session_node("session_id")
    parts = [
        exploded(sessions.select("capture_id", *memo("graph_ends", _session_ends)), memo("graph_edges", _session_edges)),
        exploded(
            named(findings, finding=ids.finding_node("finding_id"), session=own, host=ids.host_node("server_ip")),
            F.array(
                _edge(session, finding, "session_produced_finding", "rule-based finding"),
                _edge(finding, session, "finding_affects_session", "finding affects session"),
                _edge(finding, F.col("host"), "finding_affects_host", "finding affects host"),
            ),
        ),
        named(events, s=ids.event_node("session_id", "seq"), t=own).select("capture_id", F.lit(_EDGE_KIND["event_belongs_to_session", "timeline event"]).alias("kind"), "s", "t"),
        exploded(
            named(anomalies.where(F.col("band").isin(*V.FLAGGED_BANDS)), anomaly=ids.anomaly_node("anomaly_id"), session=own),
            F.array(
                _edge(session, anomaly, "session_has_anomaly", "statistical deviation"),
                _edge(anomaly, session, "anomaly_affects_session", "statistical deviation"),
            ),
        ),
        named(factors.where(F.col("contribution_cents") > 0), s=ids.capture_node("capture_id"), t=ids.posture_node("factor", "capture_id"))
        .select("capture_id", F.lit(_EDGE_KIND["capture_has_posture_factor", "posture factor"]).alias("kind"), "s", "t"),
        shared_certificate_edges(sessions),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.distinct()


def edge_names(keys: DataFrame) -> DataFrame:
    """(capture_id, kind, s, t) -> the edge with its ids and texts."""
    types, bases, sources, targets = zip(*EDGE_TYPES, strict=True)
    return keys.select(
        "capture_id", _text(_of("kind", [_PREFIX[n] for n in sources]), F.col("s")).alias("source_node_id"),
        _text(_of("kind", [_PREFIX[n] for n in targets]), F.col("t")).alias("target_node_id"), _of("kind", types).alias("edge_type"), _of("kind", bases).alias("basis"),
    )


def graph_edges(sessions, findings, events, anomalies, factors) -> DataFrame:
    """Distinct directed edges per capture."""
    return edge_names(edge_keys(sessions, findings, events, anomalies, factors))


def graph_filter(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, protocol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes by type; edges touching a remaining node of the protocol (case-insensitive)."""
    kept = nodes.where(F.col("node_type") == node_type) if node_type else nodes
    if not protocol:
        return kept, edges
    wanted = kept.where(F.lower("metadata") == protocol.lower()).select("capture_id", F.col("node_id").alias("wanted"))
    touching = lambda side: edges.join(wanted.withColumnRenamed("wanted", side), ["capture_id", side], "left_semi").select(*EDGE)
    return kept, touching("source_node_id").union(touching("target_node_id")).distinct()


def neighbors(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """One hop in both directions for requested (capture_id, node_id)."""
    out = edges.select("capture_id", F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("neighbor_id"))
    into = edges.select("capture_id", F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("neighbor_id"))
    return out.unionByName(into).join(requests, ["capture_id", "node_id"], "left_semi").distinct()


def cut_lineage(nodes: DataFrame) -> DataFrame:
    return stored_by(nodes, "capture_id", "node_id")


def graph_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first depth from the capture node along directed edges; unreachable nodes come last.

    Every round is one join of the newest frontier, and the loop ends with the
    first empty one. Edges are stored once by their source and the nodes of every
    round by node, so a round shuffles its frontier and its targets only. Parallel
    edges collapse among a round's targets.
    """
    links = stored_by(edges.select("capture_id", "source_node_id", "target_node_id"), "capture_id", "source_node_id")
    frontier = cut_lineage(nodes.where(F.col("node_type") == "capture").select("capture_id", "node_id", F.lit(0).cast("bigint").alias("depth")))
    rounds, reached = [frontier], frontier
    while not frontier.isEmpty():
        depth = len(rounds)
        step = (
            frontier.select("capture_id", F.col("node_id").alias("source_node_id")).join(links, ["capture_id", "source_node_id"])
            .select("capture_id", F.col("target_node_id").alias("node_id")).distinct()
        )
        for seen in rounds:
            step = step.join(seen.select("capture_id", "node_id"), ["capture_id", "node_id"], "left_anti")
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth).cast("bigint")))
        rounds.append(frontier)
        reached = reached.unionByName(frontier)
    deepest = reached.groupBy("capture_id").agg(F.max("depth").alias("deepest"))
    return (
        nodes.select("capture_id", "node_id").join(reached, ["capture_id", "node_id"], "left").join(deepest, "capture_id", "left")
        .select("capture_id", "node_id", F.coalesce(F.col("depth"), F.coalesce("deepest", F.lit(0)) + 1).cast("bigint").alias("depth"))
    )


def size_guard(nodes: DataFrame, limit: int = V.MAX_GRAPH_NODES) -> DataFrame:
    """Per capture: node count, whether the graph is kept, and the warning if not."""
    counted = nodes.groupBy("capture_id").agg(F.count("*").alias("node_count"))
    omitted = F.col("node_count") > limit
    warning = F.concat(
        F.lit("evidence graph omitted: "), F.col("node_count").cast("string"), F.lit(f" nodes exceed the configured limit of {limit}")
    )
    return counted.select("capture_id", "node_count", (~omitted).alias("kept"), F.when(omitted, warning).alias("warning"))


def certificate_pivots(sessions: DataFrame) -> DataFrame:
    """Certificates presented in two or more sessions of a capture."""
    uses = sessions.select("capture_id", "server_ip", "protocol", F.explode("certificates").alias("c"))
    words = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return uses.groupBy("capture_id", _fingerprint(F.col("c")).alias("fingerprint")).agg(
        F.count("*").alias("session_count"), words("server_ip").alias("host_ips"), words("protocol").alias("protocols"),
        F.countDistinct("server_ip").alias("host_count"),
    ).where(F.col("session_count") >= 2)


def tls_config_clusters(sessions: DataFrame) -> DataFrame:
    known = sessions.where(F.col("handshake").isNotNull())
    return known.groupBy("capture_id", config_fingerprint().alias("fingerprint")).agg(
        F.first(_hs("tls_version")).alias("tls_version"), F.first(_hs("cipher_suite")).alias("cipher_suite"),
        F.first(_hs("key_exchange")).alias("key_exchange"), F.count("*").alias("sessions"),
        F.countDistinct("server_ip").alias("hosts"), F.countDistinct("protocol").alias("protocols"),
    )


def investigation_context(sessions, findings, anomalies, events) -> DataFrame:
    """One context row per session: counts and identifiers of everything tied to it."""
    found = findings.groupBy("session_id").agg(
        F.count("*").alias("findings"), F.min("finding_id").alias("first_finding_id"), F.sum(F.size("evidence_refs")).alias("evidence_refs")
    )
    seen = events.groupBy("session_id").agg(F.count("*").alias("timeline_events"))
    peers = sessions.groupBy("capture_id", "server_ip").agg((F.count("*") - 1).alias("related_sessions"))
    certs = F.array_join(F.array_sort(F.array_distinct(F.transform("certificates", _fingerprint))), ",")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        sessions.join(found, "session_id", "left").join(seen, "session_id", "left").join(peers, ["capture_id", "server_ip"], "left")
        .join(anomalies.select("session_id", "anomaly_id", "score"), "session_id", "left")
        .select(
            "capture_id", "session_id", "protocol", F.col("server_ip").alias("host"), _address("client_ip", "client_port").alias("client_endpoint"),
            _address("server_ip", "server_port").alias("server_endpoint"), _hs("tls_version").alias("tls_version"),
            F.when(F.col("handshake").isNotNull(), config_fingerprint()).alias("tls_config_id"), certs.alias("certificate_ids"),
            zero("findings"), "first_finding_id", zero("evidence_refs"), "anomaly_id", F.col("score").alias("anomaly_score"), zero("timeline_events"),
            zero("related_sessions"),
        )
    )


def bounded_session_context(sessions, findings, anomalies, events, related) -> DataFrame:
    """Size-bounded JSON context per session without credential-like keys.

    Heads are cut per session before they are nested, so nothing unbounded is collected.
    """
    head = lambda df, order, n: df.withColumn("k", F.row_number().over(W.partitionBy("session_id").orderBy(*order))).where(F.col("k") <= n)
    briefs = head(findings, ["finding_id"], V.MAX_CONTEXT_FINDINGS).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("finding_id", "rule_id", "severity", "confidence", "observed_value", F.left("description", F.lit(200)).alias("description")))).alias("findings")
    )
    timeline = head(events, ["seq"], V.MAX_CONTEXT_EVENTS).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "type", "direction", iso_text("ts").alias("at"), F.to_json(strip_sensitive_keys("detail")).alias("detail")))).alias("timeline")
    )
    context = F.to_json(
        F.struct(
            F.struct("anomaly_id", "score").alias("anomaly"), "findings", F.col("first_related").alias("related_sessions"),
            F.struct("session_id", "protocol", "server_ip", "server_port", "complete", "packet_count").alias("session"), "timeline",
            F.struct(_hs("tls_version").alias("tls_version"), _hs("cipher_suite").alias("cipher_suite"), _hs("sni_server_name").alias("sni")).alias("tls"),
        )
    )
    return (
        sessions.join(briefs, "session_id", "left").join(timeline, "session_id", "left")
        .join(anomalies.select("session_id", "anomaly_id", "score"), "session_id", "left").join(related.select("session_id", "first_related", "related_count"), "session_id", "left")
        .select("capture_id", "session_id", "related_count", F.left(context, F.lit(V.MAX_CONTEXT_CHARS)).alias("context_json"))
    )


def citation_check(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Citations whose session differs from the session of the context they were given."""
    named = citations.where(F.coalesce(F.col("cited_session_id"), F.lit("")) != "")
    joined = named.join(contexts.select("context_id", F.col("session_id").alias("context_session_id")), "context_id")
    return joined.where(F.col("cited_session_id") != F.col("context_session_id"))
