"""Queries: observations, lifecycle, drift, verification and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.operators import drift as D
from postern.operators import verification as X
from postern.plans.base import query


@query("observation_build")
def observation_build(w):
    return D.observations(w.chain, w.sessions, w.findings, w.anomalies, w.posture)


@query("observation_rules")
def observation_rules(w):
    return D.rule_presence(w.findings)


@query("observation_certificates")
def observation_certificates(w):
    return D.certificate_presence(w.sessions)


@query("bounded_refs")
def bounded_refs(w):
    return D.rule_finding_ids(w.findings)


@query("join_pairwise_observations")
def join_pairwise_observations(w):
    return w.pairs


@query("join_intermediates")
def join_intermediates(w):
    return D.intermediates(w.pairs, w.chain)


@query("posture_trend")
def posture_trend(w):
    return D.posture_trend(w.chain, w.posture)


@query("comparable")
def comparable(w):
    """Every rule of a chain against every capture of the chain, first capture as anchor."""
    first = w.chain.where(F.col("pos") == 0).select("case_id", F.col("capture_id").alias("anchor_capture_id"))
    needed = w.chain.join(first, "case_id").withColumnRenamed("capture_id", "observed_capture_id")
    rules = w.findings.select("rule_id").distinct()
    keys = needed.join(F.broadcast(rules))
    return D.comparability(needed, keys, w.findings, w.sessions).select("case_id", "anchor_capture_id", "observed_capture_id", "rule_id", "comparable")


@query("endpoint_intersection")
def endpoint_intersection(w):
    e = D.endpoints(w.sessions)
    p = w.pairs.select("case_id", "previous_capture_id", "later_capture_id")
    before = p.join(e.withColumnRenamed("capture_id", "previous_capture_id"), "previous_capture_id").select("case_id", "later_capture_id", "endpoint")
    after = p.join(e.withColumnRenamed("capture_id", "later_capture_id"), "later_capture_id").select("case_id", "later_capture_id", "endpoint")
    return before.intersect(after)


@query("presence_except")
def presence_except(w):
    e = D.protocol_presence(w.sessions).select("capture_id", "protocol").unionByName(
        D.certificate_presence(w.sessions).select("capture_id", F.col("fingerprint").alias("protocol"))
    )
    p = w.pairs.select("case_id", "previous_capture_id", "later_capture_id")
    before = p.join(e.withColumnRenamed("capture_id", "previous_capture_id"), "previous_capture_id").select("case_id", "later_capture_id", F.col("protocol").alias("entity"))
    after = p.join(e.withColumnRenamed("capture_id", "later_capture_id"), "later_capture_id").select("case_id", "later_capture_id", F.col("protocol").alias("entity"))
    return before.exceptAll(after).withColumn("change", F.lit("gone")).unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))


@query("join_presence_diff")
def join_presence_diff(w):
    presence = D._located(D.tls_presence(w.sessions).select("capture_id", "fingerprint"), w.chain)
    return D.presence_changes(presence, w.chain, ["fingerprint"])


@query("rule_union_keys")
def rule_union_keys(w):
    rules = w.findings.select("capture_id", "rule_id").distinct()
    side = lambda c: w.pairs.join(rules.withColumnRenamed("capture_id", c), c).select("case_id", "later_capture_id", "rule_id")
    return side("anchor_capture_id").union(side("later_capture_id")).distinct()


LIFECYCLE = [
    "case_id", "anchor_capture_id", "previous_capture_id", "later_capture_id", "rule_id", "title", "baseline_present", "current_present",
    "lifecycle", "severity", "baseline_finding_id", "latest_finding_id", "comparable",
]


@query("finding_lifecycle")
def finding_lifecycle(w):
    return D.finding_lifecycle(w.chain, w.pairs, w.findings, w.sessions).select(*LIFECYCLE)


@query("lifecycle_at")
def lifecycle_at(w):
    """Lifecycle over the whole history: first capture as anchor, last capture as target."""
    first = w.chain.where(F.col("pos") == 0).select("case_id", F.col("capture_id").alias("baseline_capture_id"))
    pairs = D.pairs(w.chain, first)
    last = W.partitionBy("case_id")
    whole = pairs.withColumn("m", F.max("later_pos").over(last)).where(F.col("later_pos") == F.col("m")).drop("m")
    return D.finding_lifecycle(w.chain, whole, w.findings, w.sessions).select(*LIFECYCLE)


@query("drift_posture")
def drift_posture(w):
    return D.drift_posture(w.pairs, w.posture)


@query("drift_findings")
def drift_findings(w):
    return D.drift_findings(w.lifecycle, D.trace(w.chain, w.pairs, w.findings, w.sessions))


@query("drift_tls_config")
def drift_tls_config(w):
    return D.drift_tls_config(w.chain, w.pairs, w.sessions)


@query("drift_certificate")
def drift_certificate(w):
    return D.drift_certificate(w.chain, w.pairs, w.sessions)


@query("drift_certificate_validity")
def drift_certificate_validity(w):
    return D.drift_certificate_validity(w.chain, w.pairs, w.sessions)


@query("drift_protocol")
def drift_protocol(w):
    return D.drift_protocol(w.chain, w.pairs, w.sessions)


@query("drift_anomaly_bands")
def drift_anomaly_bands(w):
    return D.drift_anomaly_bands(w.chain, w.pairs, w.anomalies)


@query("drift_correlation")
def drift_correlation(w):
    return D.drift_correlation(w.chain, w.pairs, w.correlation_captures)


@query("drift_chain")
def drift_chain(w):
    return D.drift_chain(w.chain, w.pairs, w.sessions, w.findings, w.anomalies, w.posture, w.correlation_captures)


@query("drift_id")
def drift_id(w):
    return w.drift_records.select("drift_id", "case_id", "drift_type")


@query("drift_list")
def drift_list(w):
    return D.drift_list(w.drift_records).select("case_id", "position", "drift_id", "drift_type", "evidence_key")


@query("drift_summary")
def drift_summary(w):
    return D.drift_summary(w.cases, w.chain, w.baselines, w.drift_records)


@query("drift_compare_requests")
def drift_compare_requests(w):
    return w.requested_pairs.drop("later_pos", "anchor_pos")


@query("drift_compare_explicit")
def drift_compare_explicit(w):
    """Requested pairs forwards, backwards, against the stored baseline and under another anchor, in all dimensions."""
    asked = w.requested_pairs.where(F.col("problem").isNull()).drop("problem")
    return D.compare_pairs(w.chain, asked, w.sessions, w.findings, w.anomalies, w.posture, w.correlation_captures)


@query("case_comparisons")
def case_comparisons(w):
    return D.case_comparisons(w.pairs, w.sessions, w.posture, w.drift_records)


@query("join_regression_links")
def join_regression_links(w):
    return D.link_regressions(w.drift_records, w.remediations, w.verifications)


@query("drift_regression_view")
def drift_regression_view(w):
    """Per remediation: later captures, latest lifecycle and whether its rule regressed."""
    last = w.lifecycle.groupBy("case_id", "rule_id").agg(F.max_by(F.struct("lifecycle", "current_present"), "later_pos").alias("x"))
    later = w.chain.groupBy("case_id").agg((F.count("*") - 1).alias("later_observations"))
    links = D.link_regressions(w.drift_records, w.remediations, w.verifications).groupBy("case_id", F.expr("substring(evidence_key, instr(evidence_key, '|') + 1)").alias("rule")).agg(F.count("*").alias("related_drifts"))
    r = w.remediations.withColumn("rule", F.lower("rule_id"))
    return r.join(last, ["case_id", "rule_id"], "left").join(later, "case_id", "left").join(links, ["case_id", "rule"], "left").select(
        "remediation_id", "case_id", "rule_id", "status", F.col("x.lifecycle").alias("current_lifecycle"), F.col("x.current_present").alias("current_present"),
        F.coalesce("later_observations", F.lit(0)).alias("later_observations"), F.coalesce("related_drifts", F.lit(0)).alias("related_drifts"),
        F.col("related_drifts").isNotNull().alias("regression_detected"),
    )


@query("verify_rule")
def verify_rule(w):
    return X.verify(w.verification_requests, w.findings, w.sessions, w.posture)


@query("join_candidate_sessions")
def join_candidate_sessions(w):
    c = X.candidate_endpoints(w.sessions)
    f = w.findings.select("capture_id", "protocol", "server_ip", "server_port").distinct()
    return f.alias("f").join(
        c.alias("c"), F.col("f.protocol").eqNullSafe(F.col("c.protocol")) & (F.col("f.server_ip") == F.col("c.server_ip")) & (F.col("f.server_port") == F.col("c.server_port"))
    ).select("f.capture_id", "c.target_capture_id", "c.protocol", "c.server_ip", "c.server_port", "c.matched_session_id", "c.candidates")


@query("join_rule_in_candidates")
def join_rule_in_candidates(w):
    """Verification requests against the findings of the target capture's candidate sessions."""
    return X.rule_in_candidates(w.verification_requests, w.findings, w.sessions)


@query("verification_eligibility")
def verification_eligibility(w):
    attached = w.case_captures.select("case_id", F.col("capture_id").alias("target_capture_id"))  # no other capture can be eligible
    every = w.remediations.select("remediation_id", "case_id").join(attached, "case_id")
    return X.eligible(every, w.case_captures, w.captures, w.analysis).select("remediation_id", "case_id", "target_capture_id")


@query("verification_by_result")
def verification_by_result(w):
    return w.verifications.groupBy("case_id", "result").agg(F.count("*").alias("n"))


@query("remediation_from_finding")
def remediation_from_finding(w):
    return X.remediation_from_finding(w.findings)


@query("remediation_transition_check")
def remediation_transition_check(w):
    return X.transition_check(w.status_timeline).select("remediation_id", "entry_seq", "previous_status", "status")


@query("latest_status")
def latest_status(w):
    return X.latest_status(w.status_timeline)
