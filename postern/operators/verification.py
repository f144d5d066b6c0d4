"""Before/after verification of findings against later captures, and remediation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions.columns import literal_table, prefixed_sha


def candidate_endpoints(sessions: DataFrame) -> DataFrame:
    """Sessions condensed per (capture, protocol, address, port); the smallest id represents them."""
    return sessions.groupBy(F.col("capture_id").alias("target_capture_id"), "protocol", "server_ip", "server_port").agg(
        F.min("session_id").alias("matched_session_id"), F.count("*").alias("candidates")
    )


def verify(requests: DataFrame, findings: DataFrame, sessions: DataFrame, posture: DataFrame) -> DataFrame:
    """requests(finding_id, target_capture_id) -> outcome per request, all requests in one job.

    Candidate sessions have the same protocol (NULL equals NULL), server address
    and port. Both sides are condensed per endpoint before they meet.
    """
    base = requests.join(findings.select("finding_id", "rule_id", F.col("capture_id").alias("baseline_capture_id"), "session_id"), "finding_id")
    endpoint = sessions.select("session_id", F.col("protocol").alias("b_protocol"), F.col("server_ip").alias("b_ip"), F.col("server_port").alias("b_port"), F.lit(True).alias("known"))
    based = base.join(endpoint, "session_id", "left")
    c = candidate_endpoints(sessions).alias("c")
    b = based.alias("b")
    matched = b.join(
        c, (F.col("b.target_capture_id") == F.col("c.target_capture_id")) & F.col("b_protocol").eqNullSafe(F.col("c.protocol"))
        & (F.col("b_ip") == F.col("c.server_ip")) & (F.col("b_port") == F.col("c.server_port")), "left",
    ).select("b.*", "c.matched_session_id", "c.candidates")
    fired = findings.select(
        F.col("capture_id").alias("target_capture_id"), "rule_id", F.col("protocol").alias("f_protocol"), F.col("server_ip").alias("f_ip"), F.col("server_port").alias("f_port"),
    ).distinct()
    on_capture = fired.select("target_capture_id", "rule_id").distinct().withColumn("rule_in_capture", F.lit(True))
    m, f = matched.alias("m"), fired.alias("f")
    judged = m.join(
        f, (F.col("m.target_capture_id") == F.col("f.target_capture_id")) & (F.col("m.rule_id") == F.col("f.rule_id"))
        & F.col("b_protocol").eqNullSafe(F.col("f_protocol")) & (F.col("b_ip") == F.col("f_ip")) & (F.col("b_port") == F.col("f_port")), "left",
    ).select("m.*", F.col("f_ip").isNotNull().alias("rule_at_endpoint")).join(on_capture, ["target_capture_id", "rule_id"], "left")
    score = lambda capture, name: posture.select(F.col("capture_id").alias(capture), F.col("overall_score").alias(name))
    scored = judged.join(score("baseline_capture_id", "score_before"), "baseline_capture_id", "left").join(score("target_capture_id", "score_after"), "target_capture_id", "left")
    scoped = F.col("session_id").isNotNull() & F.col("known").isNotNull()
    located = F.col("b_ip").isNotNull() & F.col("b_port").isNotNull()
    match = (
        F.when(~scoped, "not_session_scoped").when(~located, "incomplete_evidence")
        .when(F.col("candidates").isNull(), "no_matching_session").otherwise("matched")
    )
    present = F.when(match == "not_session_scoped", F.coalesce("rule_in_capture", F.lit(False))).when(match == "matched", F.col("rule_at_endpoint"))
    outcome = F.when(present.isNull(), "inconclusive").when(present, "failed").otherwise("verified")
    rule, target = F.concat(F.lit("Rule "), "rule_id"), F.col("target_capture_id")
    scope = F.when(match == "matched", F.lit(" for the relevant session.")).otherwise(F.lit("."))
    statement = (
        F.when(match == "incomplete_evidence", F.concat(rule, F.lit(" could not be verified: the baseline session lacks endpoint evidence to match against.")))
        .when(match == "no_matching_session", F.concat(rule, F.lit(" could not be verified: verification capture "), target, F.lit(" does not contain the relevant session.")))
        .when(present, F.concat(rule, F.lit(" was still observed in verification capture "), target, scope))
        .otherwise(F.concat(rule, F.lit(" was not observed in verification capture "), target, scope))
    )
    return scored.select(
        *requests.columns, "rule_id", "baseline_capture_id", F.col("session_id").alias("baseline_session_id"), match.alias("session_match"),
        F.when(match == "matched", F.col("matched_session_id")).alias("verification_session_id"), present.alias("rule_present"), outcome.alias("outcome"),
        (F.col("score_after") - F.col("score_before")).alias("posture_delta_points"), statement.alias("statement"),
    )


def rule_in_candidates(requests: DataFrame, findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """The requests whose rule fired in a candidate session of the target capture, with the rule and the baseline session's endpoint."""
    baseline = findings.select("finding_id", "rule_id", "session_id")
    endpoint = sessions.select("session_id", "protocol", "server_ip", "server_port")
    asked = requests.join(baseline, "finding_id").join(endpoint, "session_id").alias("a")
    fired = findings.select(F.col("capture_id").alias("target_capture_id"), "rule_id", "protocol", "server_ip", "server_port").distinct().alias("f")
    same = [F.col(f"a.{c}") == F.col(f"f.{c}") for c in ("target_capture_id", "rule_id", "server_ip", "server_port")]
    return asked.join(fired, [*same, F.col("a.protocol").eqNullSafe(F.col("f.protocol"))], "left_semi").drop("session_id")


def eligible(requests: DataFrame, case_captures: DataFrame, captures: DataFrame, analysis: DataFrame) -> DataFrame:
    """Requests whose target is attached to the case, registered and analysed."""
    attached = case_captures.select("case_id", F.col("capture_id").alias("target_capture_id"))
    registered = captures.select(F.col("capture_id").alias("target_capture_id"))
    done = analysis.where(F.col("status") == "completed").select(F.col("capture_id").alias("target_capture_id"))
    return requests.join(attached, ["case_id", "target_capture_id"], "left_semi").join(registered, "target_capture_id", "left_semi").join(done, "target_capture_id", "left_semi")


def verification_records(verified: DataFrame) -> DataFrame:
    return verified.withColumns(
        {
            "verification_id": prefixed_sha("verif_", F.concat_ws("|", "remediation_id", "target_capture_id"), 16),
            "result": F.upper("outcome"),
        }
    )


def remediation_from_finding(findings: DataFrame) -> DataFrame:
    """Recommended action text and its source from the policy guidance of a finding."""
    action = F.trim("remediation.action")
    given = F.coalesce(action != "", F.lit(False))
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c)))
    text = F.concat_ws(
        "\n", line("Recommended action from policy baseline: ", "remediation.action"), line("Target: ", "remediation.target"), line("Rationale: ", "remediation.rationale")
    )
    return findings.select(
        "finding_id", "title", "rule_id", F.when(given, text).otherwise("").alias("recommended_action"),
        F.when(given, "policy").otherwise("analyst").alias("source"),
    )


def transition_check(timeline: DataFrame) -> DataFrame:
    """Status changes of a remediation timeline that the workflow does not allow."""
    order = W.partitionBy("remediation_id").orderBy("entry_seq")
    steps = timeline.withColumn("previous_status", F.lag("status").over(order)).where(F.col("previous_status").isNotNull())
    edges = [(a, b) for a, targets in V.REMEDIATION_TRANSITIONS.items() for b in targets]
    allowed = literal_table(timeline.sparkSession, edges, ["previous_status", "status"])
    return steps.join(F.broadcast(allowed), ["previous_status", "status"], "left_anti")


def latest_status(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("remediation_id").agg(F.max_by("status", "entry_seq").alias("status"), F.max("entry_seq").alias("entry_seq"))
