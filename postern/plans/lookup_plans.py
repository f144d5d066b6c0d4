"""Queries: scalars, lists, lookups, joins and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postern.functions import ids, labels
from postern.functions import normalize as N
from postern.functions.columns import epoch_to_timestamp, iso_text, session_duration, validity_days
from postern.operators import lookups as L
from postern.operators import reports as R
from postern.operators.rules import leaf
from postern.plans.base import query
from postern.session import shared_folder
from postern.sources import tables

S = ["session_id", "capture_id", "protocol", "server_ip", "server_port"]
FND = ["finding_id", "capture_id", "session_id", "rule_id", "severity"]


# -- scalars over whole tables -------------------------------------------------
@query("normalizers")
def normalizers(w):
    d = w.table("documents")
    head = F.substring_index("text", " ", 1)
    return d.select(
        "doc_id", N.normalize_ipv4(F.concat(F.lit(" "), F.lit("10."), (F.col("n_chars") % 300).cast("string"), F.lit(".7.1 "))).alias("ip"),
        N.normalize_port(F.col("n_chars") - 100).alias("port"), N.normalize_protocol(F.upper("source")).alias("protocol"),
        N.normalize_hostname(F.concat(F.lit("Host-"), F.col("lang"), F.lit(".Example.ORG."))).alias("hostname"),
        N.normalize_token(F.concat(F.lit("  TLS   "), F.col("lang"))).alias("token"),
        N.normalize_fingerprint(F.concat(F.lit("AB:CD "), F.hex("doc_id"))).alias("fingerprint"),
        F.coalesce(N.normalize_subject(F.concat(F.lit("CN="), F.col("source"), F.lit("  X "))), F.lit("-")).alias("subject"),
        N.normalize_evidence_key(F.concat(F.lit("key|"), F.col("lang"))).alias("evidence_key"),
    )


@query("line_scalars")
def line_scalars(w):
    """safe_value, command_and_args, redact_line and redact_arguments over whole conversation texts."""
    c = w.table("conversations")
    line = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("auth ")).when(F.col("turn") % 3 == 1, F.lit("Pass  ")).otherwise(F.lit("")), F.col("text"))
    return c.select(
        "conv_id", "turn", "role", F.md5(N.safe_value(line)).alias("safe"), N.command_word(line).alias("command"),
        F.length(N.command_arguments(line)).cast("bigint").alias("argument_length"), F.md5(N.redact_line(line)).alias("redacted"),
        F.length(N.redact_arguments(N.command_word(line), N.command_arguments(line))).cast("bigint").alias("redacted_length"),
    )


@query("session_scalars")
def session_scalars(w):
    c = leaf()
    return w.sessions.select(
        "session_id", labels.cipher_suite_name("handshake.cipher_suite_code").alias("suite_name"),
        labels.key_exchange_for_suite("handshake.cipher_suite").alias("suite_key_exchange"),
        ids.host_id("server_ip").alias("host_id"), iso_text("started_at").alias("started_text"),
        session_duration("started_at", "ended_at").alias("duration"), validity_days("started_at", c["not_after"]).alias("validity_days"),
        labels.endpoint_label("protocol", "server_ip", "server_port").alias("endpoint"), labels.starttls_state("starttls").alias("starttls_state"),
        labels.port_protocol("server_port").alias("port_protocol"), labels.implicit_tls_port("server_port").alias("port_implicit"),
        labels.safe_number("bytes_server_to_client").alias("safe_bytes"),
    )


@query("epoch_to_timestamp")
def epoch_scalar(w):
    return w.table("events").select("event_id", iso_text(epoch_to_timestamp((F.col("event_id") * 1000 + 500000000).cast("double"))).alias("at"))


@query("threshold_labels")
def threshold_labels(w):
    p = w.table("part").withColumn("score", (F.col("p_partkey") % 101).cast("int"))
    return p.select(
        "p_partkey", labels.posture_state("score").alias("posture_state"), labels.anomaly_band("score").alias("anomaly_band"),
        labels.factor_status(F.col("score") % 6 - 1).alias("factor_status"), labels.deviation_label(F.col("score") / 50).alias("deviation"),
        labels.tcp_flags_label("score").alias("tcp_flags_label"), labels.link_type_name(F.col("score")).alias("link_type"),
        labels.tls_version_name(F.col("score") + 700).alias("version"),
    )


@query("rank_labels")
def rank_labels(w):
    return w.findings.select(
        "finding_id", labels.severity_rank("severity").cast("bigint").alias("severity_rank"), labels.confidence_rank("confidence").cast("bigint").alias("confidence_rank")
    )


@query("id_shape_valid")
def id_shape_valid(w):
    return w.notes.select(
        "note_id", *[ids.id_shape_valid(k, "target_id").alias(f"is_{k}") for k in ("capture", "session", "correlation", "drift", "remediation")]
    )


@query("strip_sensitive_keys")
def strip_sensitive_keys(w):
    m = F.create_map(
        F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, "Password").otherwise("note"), F.lit("x"),
        F.when(F.col("turn") % 3 == 0, "API_KEY").otherwise("topic"), F.lit("y"),
    )
    return w.table("conversations").select("conv_id", "turn", "role", F.array_join(F.array_sort(F.map_keys(N.strip_sensitive_keys(m))), ",").alias("kept"))


# -- captures ------------------------------------------------------------------
@query("capture_identity")
def capture_identity(w):
    d = w.table("documents")
    sha = F.sha2("text", 256)
    return d.select("doc_id", sha.alias("sha256"), ids.capture_id(sha).alias("capture_id"))


@query("capture_dedup")
def capture_dedup(w):
    d = w.table("documents").select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 7).alias("ingested_at"))
    return L.capture_dedup(d)


@query("filename_valid")
def filename_valid(w):
    p = w.table("pages")
    name = F.concat(F.when(F.col("page_id") % 2 == 0, F.element_at(F.split("url", "/"), -1)).otherwise(F.col("url")), F.when(F.col("page_id") % 3 == 0, ".PCAP").when(F.col("page_id") % 3 == 1, ".pcapng").otherwise(".txt"))
    return p.select("page_id", L.valid_filename(name).alias("valid"))


@query("src_evidence_tables")
def src_evidence_tables(w):
    return w.sessions.groupBy("capture_id", "protocol").agg(F.count("*").alias("sessions"), F.sum("packet_count").alias("packets"))


@query("src_case_evidence")
def src_case_evidence(w):
    """Stored sessions of open cases; only the folders of their captures are opened."""
    path = f"{shared_folder(w.spark)}/evidence-{uuid.uuid4().hex}"
    tables.replace_captures(w.sessions.select("session_id", "capture_id", "protocol", "packet_count"), path)
    wanted = w.case_captures.join(w.cases.where(F.col("status") == "OPEN"), "case_id")
    return tables.scan(w.spark, path, wanted)


@query("analysis_status")
def analysis_status(w):
    return L.analysis_status(w.captures, w.analysis, w.sessions)


@query("capture_list")
def capture_list(w):
    rows = L.capture_list(w.captures.select("capture_id", "filename", "ingested_at"), w.analysis.select("capture_id", F.col("status").alias("analysis_status")))
    return rows.orderBy(F.col("ingested_at").desc(), "capture_id").select(
        "capture_id", "filename", iso_text("ingested_at").alias("ingested_at"), F.coalesce("analysis_status", F.lit("not_analyzed")).alias("analysis_status")
    )


# -- lookups ---------------------------------------------------------------------
@query("sessions_by_capture")
def sessions_by_capture(w):
    return L.requested(w.sessions, w.case_captures, "capture_id").select(*S)


@query("findings_by_capture")
def findings_by_capture(w):
    return L.requested(w.findings, w.case_captures, "capture_id").select(*FND)


@query("findings_by_session")
def findings_by_session(w):
    asked = w.notes.where(F.col("target_type") == "session").select(F.col("target_id").alias("session_id"))
    return L.requested(w.findings, asked, "session_id").select(*FND)


@query("finding_by_id")
def finding_by_id(w):
    return L.requested(w.findings, w.remediations.select(F.col("target_id").alias("finding_id")), "finding_id").select(*FND)


@query("anomalies_by_capture")
def anomalies_by_capture(w):
    return L.requested(w.anomalies, w.case_captures, "capture_id")


@query("anomaly_by_session")
def anomaly_by_session(w):
    asked = w.notes.where(F.col("target_type") == "session").select(F.col("target_id").alias("session_id"))
    return L.requested(w.anomalies, asked, "session_id")


@query("anomaly_by_id")
def anomaly_by_id(w):
    asked = w.findings.where(F.col("severity") == "critical").select(ids.anomaly_id("session_id").alias("anomaly_id"))
    return L.requested(w.anomalies, asked, "anomaly_id")


@query("cases_by_status")
def cases_by_status(w):
    return w.cases.where(F.col("status") == "OPEN").orderBy("case_id")


@query("finding_list")
def finding_list(w):
    return L.finding_list(w.findings, confidence="high", search="cert").orderBy("severity_position", "session_id").select(*FND, F.col("severity_position").cast("bigint").alias("severity_position"))


@query("anomaly_list")
def anomaly_list(w):
    rows = L.anomaly_list(w.anomalies, protocol="smtp").orderBy("band_position", F.col("sort_score").desc(), "session_id")
    return rows.select("anomaly_id", "session_id", F.col("band_position").cast("bigint").alias("band_position"), F.col("sort_score").cast("bigint").alias("sort_score"))


@query("facet_values")
def facet_values(w):
    return L.facet_values(w.findings, "category").orderBy("value")


@query("remediation_list")
def remediation_list(w):
    rows, order = L.remediation_list(w.remediations, search="cert", sort="priority")
    return L.page(rows, order, 20, 1).select("remediation_id", "case_id", "rule_id", "priority", "status", "total")


@query("remediations_for_finding")
def remediations_for_finding(w):
    return w.remediations.join(w.findings.select(F.col("finding_id").alias("target_id")), "target_id", "left_semi").select("remediation_id", "case_id", "target_id", "status")


@query("posture_hosts_list")
def posture_hosts_list(w):
    from postern.operators import posture

    return posture.posture_hosts(w.sessions, w.findings).where("affected").select("capture_id", "host_id", "ip", "highest_severity")


@query("posture_protocols_list")
def posture_protocols_list(w):
    from postern.operators import posture

    return posture.posture_protocols(w.sessions, w.findings).orderBy("capture_id", "protocol").select("capture_id", "protocol", "status")


@query("posture_priorities_list")
def posture_priorities_list(w):
    return w.priorities.orderBy("capture_id", "position").select("capture_id", "position", "rule_id", "priority_cents")


@query("case_activity_lists")
def case_activity_lists(w):
    part = lambda df, kind, key, order: df.select("case_id", F.lit(kind).alias("kind"), F.col(key).alias("record_id"), F.col(order).cast("bigint").alias("n"))
    return part(w.case_timeline, "timeline", "entry_id", "insert_order").unionByName(part(w.notes, "note", "note_id", "created_order")).unionByName(
        w.bookmarks.select("case_id", F.lit("bookmark").alias("kind"), F.col("bookmark_id").alias("record_id"), F.lit(0).cast("bigint").alias("n"))
    )


@query("host_detail")
def host_detail(w):
    return L.host_detail(w.sessions, w.findings)


# -- joins -----------------------------------------------------------------------
@query("join_cipher_class")
def join_cipher_class(w):
    return L.with_cipher_class(w.sessions)


@query("join_severity_weight")
def join_severity_weight(w):
    return L.severity_weights(w.findings)


@query("join_findings_sessions")
def join_findings_sessions(w):
    return w.findings.select("finding_id", "session_id").join(w.sessions.select("session_id", ids.host_id("server_ip").alias("host_id"), "client_ip"), "session_id")


@query("join_leaf_certificate")
def join_leaf_certificate(w):
    return L.leaf_certificates(w.sessions, w.certificates)


@query("join_cert_validity_interval")
def join_cert_validity_interval(w):
    return L.certificate_validity(w.sessions, w.certificates)


@query("join_sni_san")
def join_sni_san(w):
    return L.uncovered_names(w.sessions)


@query("join_related_sessions")
def join_related_sessions(w):
    return L.related_by_host(w.sessions).withColumn("first_related", F.array_join("first_related", ","))


@query("join_host_sessions_semi")
def join_host_sessions_semi(w):
    large = w.sessions.groupBy("capture_id", "server_ip").agg(F.count("*").alias("n"), F.max("bytes_server_to_client").alias("m"))
    hosts = large.where(F.col("m") > 80000).select("capture_id", "server_ip")
    members = w.sessions.join(hosts, ["capture_id", "server_ip"], "left_semi").select("session_id")
    return w.findings.select(*FND).join(members, "session_id", "left_semi")


@query("join_unattached_captures")
def join_unattached_captures(w):
    pairs = w.cases.select("case_id").crossJoin(w.captures.select("capture_id"))
    return pairs.join(w.case_captures.select("case_id", "capture_id"), ["case_id", "capture_id"], "left_anti")


@query("join_import_captures")
def join_import_captures(w):
    offered = w.table("supplier").join(w.captures, F.col("s_nationkey") == F.col("cap")).select(
        "s_suppkey", "capture_id", F.when(F.col("s_suppkey") % 4 == 0, F.sha2("s_name", 256)).otherwise(F.col("sha256")).alias("sha256")
    )
    checked = L.import_captures(offered.select("capture_id", "sha256").distinct(), w.captures)
    return offered.join(checked, ["capture_id", "sha256"]).select("s_suppkey", "capture_id", "attached", "warning")


@query("join_reference_integrity")
def join_reference_integrity(w):
    target = lambda df, c: df.select(F.col(c).alias("target_id"))
    targets = {
        "session": target(w.sessions, "session_id"), "finding": target(w.findings, "finding_id"),
        "capture": target(w.captures, "capture_id"), "case": target(w.cases, "case_id"),
    }
    records = w.notes.select(F.col("note_id").alias("record_id"), "target_type", "target_id").unionByName(
        w.bookmarks.select(F.col("bookmark_id").alias("record_id"), "target_type", "target_id")
    )
    return L.reference_integrity(records, targets).select("record_id", "target_type", "target_id")


# -- reports -----------------------------------------------------------------------
@query("report_executive_summary")
def report_executive_summary(w):
    return R.executive_summary(w.sessions, w.findings, w.anomalies, w.captures)


@query("report_tls_coverage")
def report_tls_coverage(w):
    return R.tls_coverage(w.sessions)


@query("report_tls_summary")
def report_tls_summary(w):
    return R.tls_summary(w.sessions)


@query("report_certificate_inventory")
def report_certificate_inventory(w):
    return R.certificate_inventory(w.sessions)


@query("report_findings_section")
def report_findings_section(w):
    return R.findings_section(w.findings).select("capture_id", "position", "finding_id", "severity")


@query("case_report_findings_section")
def case_report_findings_section(w):
    return R.case_findings_section(w.findings, w.case_captures).select("case_id", "position", "finding_id", "severity")


@query("report_anomaly_section")
def report_anomaly_section(w):
    return R.anomaly_section(w.anomalies)


@query("protocol_distribution")
def protocol_distribution(w):
    return w.sessions.groupBy("capture_id", "protocol").agg(F.count("*").alias("sessions")).orderBy("capture_id", F.col("sessions").desc(), "protocol")


@query("case_summary")
def case_summary(w):
    return R.case_summary(w.case_captures, w.captures, w.analysis, w.sessions, w.findings, w.anomalies, w.posture)


@query("case_counts")
def case_counts(w):
    return R.case_counts(w.case_captures, w.notes, w.bookmarks, w.case_timeline)


@query("case_posture_summaries")
def case_posture_summaries(w):
    return w.posture.join(w.case_captures.select("case_id", "capture_id"), "capture_id").orderBy("case_id", "capture_id").select(
        "case_id", "capture_id", "posture_state", "overall_score", "confidence", "total_sessions", "affected_sessions"
    )


@query("remediation_counts")
def remediation_counts(w):
    return R.remediation_counts(w.remediations)


@query("remediation_by_status")
def remediation_by_status(w):
    return w.remediations.groupBy("case_id", "status").agg(F.count("*").alias("n"))


@query("evidence_manifest")
def evidence_manifest(w):
    m = R.evidence_manifest(w.case_captures, w.captures, w.analysis)
    return m.withColumns({"ingested_at": iso_text("ingested_at"), "analyzed_at": iso_text("analyzed_at"), "status": F.coalesce("status", F.lit("not_analyzed"))})


@query("evidence_digest")
def evidence_digest(w):
    rows = w.findings.join(w.case_captures.select("case_id", "capture_id"), "capture_id").select(
        "case_id", F.concat_ws("|", "finding_id", "severity", "confidence", "observed_value").alias("text")
    )
    return R.evidence_digest(rows)
