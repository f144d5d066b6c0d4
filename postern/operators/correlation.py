"""Shared-evidence correlation over the captures of a case.

Every observation is filed under evidence keys in one pass over sessions,
findings and anomalies; a key seen in two or more captures of a case is a
correlation. Keys such as a protocol can hold most sessions of a case, so

* counts, capture sets and time ranges come from partial aggregates per
  (key, capture, evidence);
* members are a child table, never an array per key;
* the identifying digest over all members is a tree, see :func:`member_digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import ids, labels
from postern.functions import normalize as N
from postern.functions.columns import memo, prefixed_sha
from postern.operators.digests import tree_text

KEY = ["case_id", "correlation_type", "evidence_key"]
DIRECT, DERIVED = "direct", "derived"
DIGEST_LEAF = 65_536


def _entry(kind: str, strength: str, key: Column, **evidence: Column) -> Column:
    """One index entry; its key is NULL when an ingredient is not usable (filtered after the explode)."""
    pairs = F.array_compact(
        F.array(*[
            F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in evidence.items()
        ])
    )
    return F.struct(
        F.lit(kind).alias("correlation_type"), F.lit(strength).alias("strength"), key.alias("evidence_key"),
        F.to_json(pairs).alias("evidence"),
    )


def _usable(entries: DataFrame) -> DataFrame:
    return entries.where(N.normalize_evidence_key("evidence_key").isNotNull())


def normalised(sessions: DataFrame) -> DataFrame:
    """Every ingredient normalised once, so that the entries only combine plain columns."""
    tokens = {f"n_{t}": N.normalize_token(f"handshake.{t}") for t in ("tls_version", "cipher_suite", "key_exchange")}
    chain = F.transform(
        "certificates",
        lambda c: F.struct(
            N.normalize_fingerprint(c["fingerprint_sha256"]).alias("fingerprint"), N.normalize_subject(c["subject"]).alias("n_subject"),
            N.normalize_subject(c["issuer"]).alias("n_issuer"), c["subject"].alias("subject"), c["issuer"].alias("issuer"),
        ),
    )
    first = sessions.select(
        "capture_id", "session_id", "started_at", N.stored_ip("server_ip").alias("n_ip"), N.normalize_port("server_port").alias("n_port"),
        N.normalize_protocol("protocol").alias("n_protocol"), *[c.alias(n) for n, c in tokens.items()],
        N.normalize_hostname("handshake.sni_server_name").alias("n_sni"), chain.alias("n_chain"),
        labels.python_bool_text("implicit_tls").alias("n_implicit"), labels.starttls_state("starttls").alias("n_starttls"),
        F.when(F.col("handshake").isNotNull(), labels.python_bool_text("handshake.handshake_complete")).alias("n_complete"),
    )
    known = F.col("n_tls_version").isNotNull() & F.col("n_cipher_suite").isNotNull() & F.col("n_key_exchange").isNotNull()
    config = ids.tls_config_fingerprint(F.col("n_tls_version"), F.col("n_cipher_suite"), F.col("n_key_exchange"))
    # The server name counts only when the whole negotiated configuration is known.
    return first.withColumns({"n_config": F.when(known, config), "n_sni": F.when(known, F.col("n_sni"))})


def host_entry() -> Column:
    ip = F.col("n_ip")
    return _entry("shared_host", DIRECT, F.concat(F.lit("host|"), ip), ip=ip)


def endpoint_entry() -> Column:
    ip, port = F.col("n_ip"), F.col("n_port")
    key = F.concat(F.lit("endpoint|"), ip, F.lit("|"), port.cast("string"))
    return _entry("shared_endpoint", DIRECT, key, ip=ip, port=port)


def protocol_entry() -> Column:
    protocol = F.col("n_protocol")
    return _entry("shared_protocol", DERIVED, F.concat(F.lit("protocol|"), protocol), protocol=protocol)


def tls_config_entry() -> Column:
    return _entry(
        "shared_tls_configuration", DIRECT, F.concat(F.lit("tls-config|"), F.col("n_config")), tls_version=F.col("n_tls_version"),
        cipher_suite=F.col("n_cipher_suite"), key_exchange=F.col("n_key_exchange"), config_fingerprint=F.col("n_config"),
    )


def sni_entry() -> Column:
    return _entry(
        "shared_evidence", DERIVED, F.concat(F.lit("sni|"), F.col("n_sni")), subtype=F.lit("server_name_indication"),
        server_name=F.col("n_sni"),
    )


def session_pattern_entry() -> Column:
    protocol = F.coalesce("n_protocol", F.lit("unknown"))
    version = F.coalesce("n_tls_version", F.lit("none"))
    known = lambda c: F.nullif(F.col(c), F.lit("None"))
    key = F.concat(
        F.lit("session-pattern|"), protocol, F.lit("|implicit="), "n_implicit", F.lit("|starttls="), "n_starttls",
        F.lit("|tls="), version, F.lit("|complete="), F.coalesce("n_complete", F.lit("none")),
    )
    return _entry(
        "repeated_session_pattern", DERIVED, key, protocol=protocol, implicit_tls=known("n_implicit"), starttls=F.col("n_starttls"),
        tls_version=version, handshake_complete=known("n_complete"),
    )


def certificate_entry(c: Column) -> Column:
    return _entry(
        "shared_certificate", DIRECT, F.concat(F.lit("certificate|"), c["fingerprint"]), fingerprint_sha256=c["fingerprint"],
        subject=c["subject"], issuer=c["issuer"],
    )


def subject_entry(c: Column) -> Column:
    key = F.concat(F.lit("certificate-subject|"), c["n_subject"])
    return _entry("shared_certificate_subject", DERIVED, key, subject=c["n_subject"])


def issuer_entry(c: Column) -> Column:
    key = F.concat(F.lit("certificate-issuer|"), c["n_issuer"])
    return _entry("shared_evidence", DERIVED, key, subtype=F.lit("certificate_issuer"), issuer=c["n_issuer"])


SESSION_ENTRIES = {
    "host": host_entry,
    "endpoint": endpoint_entry,
    "protocol": protocol_entry,
    "tls_config": tls_config_entry,
    "sni": sni_entry,
    "session_pattern": session_pattern_entry,
}
CERTIFICATE_ENTRIES = {"certificate": certificate_entry, "cert_subject": subject_entry, "cert_issuer": issuer_entry}


def index_sessions(sessions: DataFrame, which: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of sessions and their certificates, all keys in one scan."""
    wanted = which or (*SESSION_ENTRIES, *CERTIFICATE_ENTRIES)

    def build() -> Column:
        own = F.array(*[SESSION_ENTRIES[n]() for n in wanted if n in SESSION_ENTRIES])
        parts = [own] if any(n in SESSION_ENTRIES for n in wanted) else []
        parts += [F.transform("n_chain", CERTIFICATE_ENTRIES[n]) for n in wanted if n in CERTIFICATE_ENTRIES]
        return F.concat(*parts)

    return _usable(normalised(sessions).select(
        "capture_id", "session_id", F.lit("").alias("finding_id"), F.lit("").alias("anomaly_id"),
        F.col("started_at").alias("observed_at"), F.explode(memo(("index", wanted), build)).alias("e"),
    ).select("capture_id", "session_id", "finding_id", "anomaly_id", "observed_at", "e.*"))


def index_findings(findings: DataFrame) -> DataFrame:
    rule = F.trim("rule_id")
    usable = (F.length(rule) > 0) & (F.length(rule) <= 128)
    entry = _entry(
        "shared_finding", DIRECT, F.when(usable, F.concat(F.lit("finding-rule|"), F.lower(rule))),
        rule_id=F.col("rule_id"), severity=F.col("severity"),
    )
    return _usable(findings.select(
        "capture_id", F.coalesce("session_id", F.lit("")).alias("session_id"), "finding_id",
        F.lit("").alias("anomaly_id"), F.col("detected_at").alias("observed_at"), entry.alias("e"),
    ).select("capture_id", "session_id", "finding_id", "anomaly_id", "observed_at", "e.*"))


def index_anomalies(anomalies: DataFrame) -> DataFrame:
    band = F.lower(F.trim(F.coalesce("band", "status")))
    flagged = F.when(band.isin(*V.FLAGGED_BANDS), band)
    entry = _entry("shared_anomaly_pattern", DERIVED, F.concat(F.lit("anomaly-band|"), flagged), band=flagged)
    return _usable(anomalies.select(
        "capture_id", "session_id", F.lit("").alias("finding_id"), "anomaly_id",
        F.lit(None).cast("timestamp").alias("observed_at"), entry.alias("e"),
    ).select("capture_id", "session_id", "finding_id", "anomaly_id", "observed_at", "e.*"))


def index_union(sessions: DataFrame, findings: DataFrame, anomalies: DataFrame, case_captures: DataFrame) -> DataFrame:
    """All evidence keys of all cases; a capture attached to several cases counts in each."""
    entries = index_sessions(sessions).unionByName(index_findings(findings)).unionByName(index_anomalies(anomalies))
    return entries.join(case_captures.select("case_id", "capture_id", "idx"), "capture_id")


def _grouped(entries: DataFrame) -> DataFrame:
    """Entries condensed to one row per (key, capture, evidence)."""
    return entries.groupBy(*KEY, "strength", "capture_id", "evidence").agg(
        F.count("*").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"),
        F.min(F.struct("idx", F.coalesce("observed_at", F.lit("9999-01-01").cast("timestamp")), "session_id", "finding_id", "anomaly_id")).alias("rank"),
    )


def _shared(condensed: DataFrame) -> DataFrame:
    keys = condensed.groupBy(*KEY).agg(
        F.min("strength").alias("strength"), F.sum("n").alias("occurrence_count"),
        F.countDistinct("capture_id").alias("capture_count"),
        F.min("first").alias("first_observed_at"), F.max("last").alias("last_observed_at"),
    )
    return keys.where(F.col("capture_count") >= 2)


def shared_keys(entries: DataFrame) -> DataFrame:
    return _shared(_grouped(entries))


def merge_evidence(condensed: DataFrame) -> DataFrame:
    """Per key and field: the first value, and the distinct values (up to 25) when they differ."""
    field = F.from_json("evidence", "array<struct<k:string,v:string>>")
    rows = condensed.select(*KEY, "rank", F.explode(field).alias("f")).select(
        *KEY, "rank", F.col("f.k").alias("field"), F.col("f.v").alias("value")
    )
    values = rows.groupBy(*KEY, "field", "value").agg(F.min("rank").alias("rank"))
    order = W.partitionBy(*KEY, "field").orderBy("value")
    bounded = values.withColumn("n", F.row_number().over(order)).where(F.col("n") <= V.MAX_OBSERVED_VALUES)
    first = values.groupBy(*KEY, "field").agg(F.min_by("value", "rank").alias("value"), F.count("*").alias("distinct_values"))
    several = (
        first.where(F.col("distinct_values") > 1).select(*KEY, "field").join(bounded, [*KEY, "field"])
        .groupBy(*KEY, "field").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("value"))
        .select(*KEY, F.concat("field", F.lit("_observed")).alias("field"), "value")
    )
    return first.select(*KEY, "field", "value").unionByName(several)


def evidence_text(merged: DataFrame) -> DataFrame:
    """The merged evidence of a key as one text (a handful of fields)."""
    pairs = F.array_sort(F.collect_list(F.concat("field", F.lit("="), "value")))
    return merged.groupBy(*KEY).agg(F.array_join(pairs, "; ").alias("evidence"))


def members(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (capture, session, finding, anomaly) members of the shared keys."""
    distinct = entries.select(*KEY, "capture_id", "session_id", "finding_id", "anomaly_id").distinct()
    return distinct.join(keys.select(*KEY, "occurrence_count"), KEY)


def member_digest(members_: DataFrame, leaf: int = DIGEST_LEAF) -> DataFrame:
    """Correlation id per key: SHA-256 over case, type, key and the text of the tree over all member ids.

    With at most ``leaf`` occurrences that text is the sorted member ids, joined.
    """
    source = F.concat_ws("|", *[F.nullif(c, F.lit("")) for c in ("capture_id", "session_id", "finding_id", "anomaly_id")])
    whole = tree_text(members_.select(*KEY, source.alias("item"), F.col("occurrence_count").alias("n")), KEY, leaf)
    identity = F.concat_ws("|", *KEY, "text")
    return whole.select(*KEY, prefixed_sha("corr_", identity, 16).alias("correlation_id"))


def correlate(entries: DataFrame, leaf: int = DIGEST_LEAF) -> DataFrame:
    """One row per evidence key observed in two or more captures of a case."""
    condensed = _grouped(entries)
    return correlated(condensed, members(entries, _shared(condensed)), leaf)


def correlated(condensed: DataFrame, inside: DataFrame, leaf: int = DIGEST_LEAF) -> DataFrame:
    """``correlate`` from the condensed entries and the members of the shared keys, which may be stored: each is read more than once."""
    keys = _shared(condensed)
    counted = inside.where(F.col("session_id") != "").select(*KEY, "session_id").distinct().groupBy(*KEY).agg(
        F.count("*").alias("session_count")
    )
    evidence = evidence_text(merge_evidence(condensed.join(keys.select(*KEY), KEY, "left_semi")))
    return (
        keys.join(member_digest(inside, leaf), KEY).join(counted, KEY, "left").join(evidence, KEY, "left")
        .select(
            "correlation_id", *KEY, "strength", "evidence", "occurrence_count", "capture_count",
            F.coalesce("session_count", F.lit(0)).alias("session_count"), "first_observed_at", "last_observed_at",
        )
    )


def correlation_captures(entries: DataFrame) -> DataFrame:
    """Child table: the captures sharing each key."""
    condensed = _grouped(entries)
    return condensed.select(*KEY, "capture_id").distinct().join(_shared(condensed).select(*KEY), KEY)


def bounded_occurrences(entries: DataFrame, limit: int = V.MAX_OCCURRENCES) -> DataFrame:
    """The first occurrences per key by (capture, session)."""
    order = W.partitionBy(*KEY).orderBy("capture_id", "session_id", "finding_id", "anomaly_id")
    keys = shared_keys(entries).select(*KEY)
    return (
        entries.select(*KEY, "capture_id", "session_id", "finding_id", "anomaly_id", "observed_at")
        .withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
        .join(keys, KEY, "left_semi")
    )


def bounded_correlations(correlations: DataFrame, limit: int = V.MAX_CORRELATIONS) -> DataFrame:
    order = W.partitionBy("case_id").orderBy("correlation_type", "evidence_key")
    return correlations.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def correlation_summary(entries: DataFrame, sessions: DataFrame, case_captures: DataFrame) -> DataFrame:
    """Per case: captures, scanned sessions, index keys and correlations by type."""
    condensed = _grouped(entries)
    index_keys = condensed.select(*KEY).distinct().groupBy("case_id").agg(F.count("*").alias("index_keys"))
    by_type = _shared(condensed).groupBy("case_id", "correlation_type").agg(F.count("*").alias("correlations"))
    per_capture = sessions.groupBy("capture_id").agg(F.count("*").alias("sessions"))
    scanned = case_captures.join(per_capture, "capture_id", "left").groupBy("case_id").agg(
        F.count("*").alias("capture_count"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions_scanned")
    )
    return scanned.join(index_keys, "case_id", "left").join(by_type, "case_id", "left").select(
        "case_id", "capture_count", "sessions_scanned", F.coalesce("index_keys", F.lit(0)).alias("index_keys"),
        "correlation_type", F.coalesce("correlations", F.lit(0)).alias("correlations"),
    )


def correlation_list(
    correlations: DataFrame, captures_of: DataFrame, *, kind: str | None = None, capture_id: str | None = None,
    needles: tuple[str, ...] = (), sort: str = "occurrences", limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Filtered and sorted page per call, with the total before paging."""
    rows = correlations
    if kind:
        rows = rows.where(F.col("correlation_type") == kind.strip().lower())
    if capture_id:
        holding = captures_of.where(F.col("capture_id") == capture_id.strip()).select(*KEY)
        rows = rows.join(holding, KEY, "left_semi")
    for needle in needles:
        rows = rows.where(F.lower("evidence_key").contains(needle.strip().lower()))
    order = {
        "occurrences": [F.col("occurrence_count").desc(), F.col("correlation_id")],
        "type": [F.col("correlation_type"), F.col("evidence_key"), F.col("correlation_id")],
        "first_observed": [F.col("first_observed_at").asc_nulls_last(), F.col("correlation_id")],
        "last_observed": [F.col("last_observed_at").asc_nulls_last(), F.col("correlation_id")],
    }[sort]
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def related_sessions(members_: DataFrame, correlations: DataFrame) -> DataFrame:
    """Per (session, correlation): how many other sessions and captures share the key.

    Counts of the others follow from the key's totals; no pairs are formed.
    """
    distinct = members_.where(F.col("session_id") != "").select(*KEY, "capture_id", "session_id").distinct()
    return distinct.join(
        correlations.select(*KEY, "correlation_id", "session_count", "capture_count"), KEY
    ).select(
        "case_id", "session_id", "capture_id", "correlation_id", "correlation_type", "evidence_key",
        (F.col("session_count") - 1).alias("other_session_count"),
        (F.col("capture_count") - 1).alias("other_capture_count"),
    )


def related_session_ids(members_: DataFrame, requests: DataFrame, limit: int = V.MAX_RELATED_IDS) -> DataFrame:
    """For requested sessions: the first other session ids of every shared key.

    The heads of the keys (limit + 1 ids) are cut once per key; each request
    then drops its own id, which keeps the work linear in the members.
    """
    distinct = members_.where(F.col("session_id") != "").select(*KEY, "session_id").distinct()
    order = W.partitionBy(*KEY).orderBy("session_id")
    heads = (
        distinct.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
        .groupBy(*KEY).agg(F.array_sort(F.collect_list("session_id")).alias("head"))
    )
    mine = distinct.join(requests.select("session_id").distinct(), "session_id", "left_semi")
    others = F.filter("head", lambda s: s != F.col("session_id"))
    return mine.join(heads, KEY).select(*KEY, "session_id", F.slice(others, 1, limit).alias("other_session_ids"))


def context_ids(members_: DataFrame, correlations: DataFrame, column: str, limit: int = V.MAX_RELATED_IDS) -> DataFrame:
    """Related finding or anomaly ids of every correlation, the first ``limit`` by id."""
    rows = members_.where(F.col(column) != "").select(*KEY, column).distinct()
    order = W.partitionBy(*KEY).orderBy(column)
    bounded = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return bounded.join(correlations.select(*KEY, "correlation_id"), KEY).select(
        "case_id", "correlation_id", F.col(column).alias("related_id"), "position"
    )


def context_timeline(correlation_captures_: DataFrame, correlations: DataFrame, timeline: DataFrame,
                     limit: int = V.MAX_RELATED_IDS) -> DataFrame:
    """Case timeline entries naming a capture of the correlation, the first ``limit`` in insertion order.

    Heads per (case, capture) are cut before the join: an entry beyond the first
    ``limit`` of its own capture cannot be among the first of any correlation.
    """
    per_capture = W.partitionBy("case_id", "detail_capture_id").orderBy("insert_order")
    heads = timeline.withColumn("n", F.row_number().over(per_capture)).where(F.col("n") <= limit).drop("n")
    joined = correlation_captures_.join(
        heads, (heads["case_id"] == correlation_captures_["case_id"])
        & (heads["detail_capture_id"] == correlation_captures_["capture_id"]),
    ).select(correlation_captures_["case_id"], "correlation_type", "evidence_key", "entry_id", "event_type", "insert_order")
    order = W.partitionBy(*KEY).orderBy("insert_order")
    return (
        joined.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
        .join(correlations.select(*KEY, "correlation_id"), KEY)
        .select("case_id", "correlation_id", "entry_id", "event_type", "position")
    )


def evidence_nodes(members_: DataFrame, merged: DataFrame, correlations: DataFrame) -> DataFrame:
    """Graph nodes that explain each correlation, besides its sessions and captures."""
    fields = merged.where(~F.col("field").endswith("_observed")).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m")
    )
    kind, rest = F.col("correlation_type"), F.substring_index("evidence_key", "|", -1)
    tail = F.expr("substring(evidence_key, instr(evidence_key, '|') + 1)")
    get = lambda name, default: F.coalesce(F.try_element_at("m", F.lit(name)), default)
    node = lambda i, t, label: F.struct(i.alias("node_id"), F.lit(t).alias("node_type"), label.alias("label"))
    fingerprint = get("fingerprint_sha256", tail)
    config = get("config_fingerprint", tail)
    ip, port = get("ip", rest), F.try_element_at("m", F.lit("port"))
    chosen = (
        F.when(kind == "shared_certificate", node(ids.certificate_node(fingerprint), "certificate", F.left(fingerprint, F.lit(16))))
        .when(kind == "shared_certificate_subject", node(ids.certificate_node(tail), "certificate", F.left(get("subject", F.col("evidence_key")), F.lit(64))))
        .when(kind == "shared_tls_configuration", node(ids.tls_config_node(config), "tls_configuration", config))
        .when(kind == "shared_host", node(ids.host_node(get("ip", tail)), "host", get("ip", tail)))
        .when((kind == "shared_endpoint") & port.isNotNull(), node(ids.endpoint_node(ip, port), "endpoint", F.concat_ws(":", ip, port)))
        .when(kind == "shared_protocol", node(ids.protocol_node(get("protocol", tail)), "protocol", get("protocol", tail)))
    )
    named = correlations.select(*KEY, "correlation_id")
    single = named.join(fields, KEY).select("case_id", "correlation_id", chosen.alias("n")).where("n IS NOT NULL")
    listed = []
    for column, build, node_type in (("finding_id", ids.finding_node, "finding"), ("anomaly_id", ids.anomaly_node, "anomaly")):
        order = W.partitionBy(*KEY).orderBy("capture_id", "session_id", column)
        heads = (
            members_.where(F.col(column) != "").withColumn("n", F.row_number().over(order))
            .where(F.col("n") <= V.MAX_OCCURRENCES).drop("n")
        )
        listed.append(
            heads.join(named, KEY).select("case_id", "correlation_id", node(build(column), node_type, F.col(column)).alias("n"))
        )
    return single.unionByName(listed[0]).unionByName(listed[1]).select("case_id", "correlation_id", "n.*")


def investigation_graph(
    case_captures: DataFrame, correlations: DataFrame, members_: DataFrame, nodes: DataFrame,
    session_budget: int = V.MAX_GRAPH_SESSIONS,
) -> DataFrame:
    """Layered edges of the case graph; sessions up to a budget, truncation flagged.

    Sessions are taken in the order (correlation type, key, session id).
    """
    case_node = F.concat(F.lit("case_"), F.col("case_id"))
    capture_node = F.concat(F.lit("capture_"), F.col("capture_id"))
    correlation_node = F.concat(F.lit("correlation_"), F.col("correlation_id"))
    edge = lambda df, s, t, kind, layer, basis: df.select(
        "case_id", s.alias("source_node_id"), t.alias("target_node_id"), F.lit(kind).alias("edge_type"),
        F.lit(layer).alias("layer"), F.lit(basis).alias("basis"),
    )
    # members repeat a session for its findings and anomalies: that changes no minimum, and only shown rows are made distinct
    named = members_.where(F.col("session_id") != "").select(*KEY, "capture_id", "session_id").join(
        correlations.select(*KEY, "correlation_id"), KEY
    )
    first_seen = named.groupBy("case_id", "session_id").agg(
        F.min(F.struct("correlation_type", "evidence_key")).alias("at"), F.min("capture_id").alias("capture_id")
    )
    order = W.partitionBy("case_id").orderBy("at", "session_id")
    kept = first_seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= session_budget)
    shown = named.join(kept.select("case_id", "session_id"), ["case_id", "session_id"], "left_semi").distinct()
    shared = "shared evidence observation"
    return (
        edge(case_captures, case_node, capture_node, "case_contains_capture", "correlation", "case attachment reference")
        .unionByName(edge(correlations, case_node, correlation_node, "case_groups_correlation", "correlation", shared))
        .unionByName(edge(kept, capture_node, ids.session_node("session_id"), "capture_contains_session", "forensic", "analysis record"))
        .unionByName(edge(shown, correlation_node, ids.session_node("session_id"), "correlation_involves_session", "correlation", shared))
        .unionByName(edge(nodes, correlation_node, F.col("node_id"), "correlation_explained_by_evidence", "correlation", shared))
        .distinct()
    )
