"""Explainable posture per capture, from findings and sessions.

All arithmetic is in integers: deductions in hundredths of a point, severity
weight times confidence in quarters, every rounding half-to-even. Findings that
share (rule, observed value, severity, confidence) have the same deduction, so
the score works on *condition groups* with counts. The input is the nested form
of ``rules.session_hits`` (or ``rules.nest`` over a stored table): because each
session's findings sit in one row, distinct session counts are plain sums, and
only group totals are ever shuffled. A capture holding a third of all rows is
spread by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import ids, labels
from postern.functions.columns import cents_text, half_even, literal_table

CONDITION = ["capture_id", "rule_id", "observed_value"]


def _first_of(key) -> Column:
    """Whether hit ``i`` is the first of its session with this key (so sums count distinct sessions)."""
    keys = F.transform("hits", key)
    return F.array_position(keys, key(F.col("h"))) == F.col("i") + 1


def hit_rows(hits: DataFrame) -> DataFrame:
    """Exploded hits, flagged so that plain sums give distinct session counts."""
    rows = hits.select("capture_id", "session_id", "server_ip", "hits", F.posexplode("hits").alias("i", "h"))
    return rows.select(
        "capture_id", "session_id", "server_ip", F.col("h.rule_id").alias("rule_id"), F.col("h.observed_value").alias("observed_value"),
        F.col("h.severity").alias("severity"), F.col("h.confidence").alias("confidence"),
        F.col("h.finding_id").alias("finding_id"), F.col("h.title").alias("title"),
        F.size("h.evidence_refs").cast("bigint").alias("refs"),
        _first_of(lambda h: F.struct(h["rule_id"], h["observed_value"])).cast("bigint").alias("first_in_condition"),
        _first_of(lambda h: h["rule_id"]).cast("bigint").alias("first_in_rule"),
        _first_of(lambda h: labels.factor_of_rule(h["rule_id"])).cast("bigint").alias("first_in_factor"),
    )


def session_totals(hits: DataFrame) -> DataFrame:
    """Sessions and hosts, affected sessions and hosts per capture: hosts first, then captures."""
    hosts = hits.groupBy("capture_id", "server_ip").agg(
        F.count("*").alias("sessions"), F.count_if(F.size("hits") > 0).alias("affected")
    )
    return hosts.groupBy("capture_id").agg(
        F.sum("sessions").alias("total_sessions"), F.count("*").alias("total_hosts"),
        F.sum("affected").alias("affected_sessions"), F.count_if(F.col("affected") > 0).alias("affected_hosts"),
    )


def condition_prevalence(hits: DataFrame) -> DataFrame:
    """Distinct sessions per (rule, observed value), by a plain partial aggregate."""
    return hit_rows(hits).groupBy(*CONDITION).agg(F.sum("first_in_condition").alias("affected_sessions"))


def _quarters(severity: str = "severity", confidence: str = "confidence") -> Column:
    """Severity weight times confidence multiplier, in quarter points."""
    return labels.severity_weight(severity) * labels.confidence_quarters(confidence)


def _deduction_cents(affected: str = "affected_sessions", total: str = "total_sessions") -> Column:
    """weight x confidence x (0.5 + 0.5 x prevalence), in hundredths."""
    n = F.col(total)
    a = F.least(F.col(affected), n)
    return half_even(_quarters() * (n + a) * 100, n * 8)


def conditions(hits: DataFrame) -> DataFrame:
    """Condition groups with counts, deduction and a deterministic representative."""
    groups = hit_rows(hits).groupBy(*CONDITION, "severity", "confidence").agg(
        F.count("*").alias("findings"), F.sum("refs").alias("evidence_count"),
        F.sum("first_in_condition").alias("sessions"),
        F.min(F.struct("finding_id", "title")).alias("first"),
    )
    per_condition = F.sum("sessions").over(W.partitionBy(*CONDITION))
    return (
        groups.withColumn("affected_sessions", per_condition)
        .join(session_totals(hits).select("capture_id", "total_sessions"), "capture_id")
        .withColumn("deduction_cents", _deduction_cents())
        .withColumn("factor", labels.factor_of_rule("rule_id"))
    )


def finding_deduction(hits: DataFrame) -> DataFrame:
    """Deduction of every single finding."""
    per_condition = condition_prevalence(hits).join(
        session_totals(hits).select("capture_id", "total_sessions"), "capture_id"
    )
    return (
        hit_rows(hits).select("finding_id", *CONDITION, "session_id", "severity", "confidence", "title")
        .join(per_condition, CONDITION)
        .withColumn("deduction_cents", _deduction_cents())
        .withColumn("factor", labels.factor_of_rule("rule_id"))
    )


def affected(hits: DataFrame, key: str, flag: str) -> DataFrame:
    """Distinct affected sessions and hosts per (capture, key): hosts first, then captures."""
    rows = hit_rows(hits).withColumn("factor", labels.factor_of_rule("rule_id"))
    hosts = rows.groupBy("capture_id", key, "server_ip").agg(F.sum(flag).alias("sessions"))
    return hosts.groupBy("capture_id", key).agg(
        F.sum("sessions").alias("affected_sessions"), F.count("*").alias("affected_hosts")
    )


def _dominant() -> Column:
    """The group with the highest deduction; the smallest finding id wins a tie."""
    return F.min(F.struct((-F.col("deduction_cents")).alias("order"), F.col("first"), "severity", "confidence"))


def posture_factors(hits: DataFrame) -> DataFrame:
    """Every factor of every analysed capture, including the factors without findings."""
    spark = hits.sparkSession
    known = literal_table(spark, list(V.FACTOR_LABELS.items()), ["factor", "label"])
    groups = conditions(hits)
    per_factor = groups.groupBy("capture_id", "factor").agg(
        F.max("deduction_cents").alias("highest"),
        F.sum(F.col("deduction_cents") * F.col("findings")).alias("total"),
        F.sum("findings").alias("conditions"),
        F.max(labels.severity_rank("severity")).alias("worst"),
        _dominant().alias("dominant"),
    )
    reach = affected(hits, "factor", "first_in_factor")
    every = session_totals(hits).select("capture_id", "total_sessions").crossJoin(F.broadcast(known))
    rows = every.join(per_factor, ["capture_id", "factor"], "left").join(reach, ["capture_id", "factor"], "left")
    contribution = half_even(F.col("highest") * 3 + F.col("total"), 4)
    return rows.select(
        "capture_id", "factor", "label", "total_sessions",
        labels.factor_status("worst").alias("status"),
        F.coalesce(contribution, F.lit(0)).alias("contribution_cents"),
        F.coalesce("affected_sessions", F.lit(0)).alias("affected_sessions"),
        F.coalesce("affected_hosts", F.lit(0)).alias("affected_hosts"),
        F.coalesce("conditions", F.lit(0)).alias("conditions"),
        F.when(
            F.col("conditions").isNotNull(),
            F.concat(
                F.lit("Dominated by '"), F.col("dominant.first.title"), F.lit("' ("),
                F.col("conditions").cast("string"), F.lit(" condition(s) correlated in this domain)."),
            ),
        ).otherwise("No findings in this domain.").alias("explanation"),
    )


def factor_findings(hits: DataFrame) -> DataFrame:
    """Contributing findings of each factor; order by deduction descending, then id."""
    return finding_deduction(hits).where(F.col("factor") != "other").select(
        "capture_id", "factor", "deduction_cents", "finding_id"
    )


def posture_score(factors: DataFrame) -> DataFrame:
    total = factors.groupBy("capture_id").agg(F.sum("contribution_cents").alias("deduction_cents"))
    score = half_even(10000 - F.least(F.lit(10000), F.col("deduction_cents")), 100)
    return total.select(
        "capture_id", F.least(F.lit(10000), F.col("deduction_cents")).alias("deduction_cents"),
        score.alias("overall_score"), labels.posture_state(score).alias("posture_state"),
    )


def posture_confidence(hits: DataFrame) -> DataFrame:
    """Weakest confidence among the three largest positive deductions of a capture.

    A condition group can stand for several findings; three groups always cover
    the top three findings, and counts decide how many of them are needed.
    """
    order = W.partitionBy("capture_id").orderBy(
        F.col("deduction_cents").desc(), F.col("first.finding_id"), "severity", "confidence"
    )
    top = (
        conditions(hits).where(F.col("deduction_cents") > 0)
        .withColumn("position", F.row_number().over(order)).where(F.col("position") <= 3)
    )
    seen = F.sum("findings").over(order.rowsBetween(W.unboundedPreceding, -1))
    used = top.withColumn("seen", F.coalesce(seen, F.lit(0))).where(F.col("seen") < 3)
    weakest = used.groupBy("capture_id").agg(F.min(labels.confidence_rank("confidence")).alias("rank"))
    return (
        session_totals(hits).select("capture_id").join(weakest, "capture_id", "left")
        .select("capture_id", F.coalesce(F.when(F.col("rank").isNotNull(), labels.confidence_of_rank("rank")), F.lit("high")).alias("confidence"))
    )


def _words(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def posture_hosts(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Per server address: sessions, protocols, versions, findings, worst severity."""
    key = ["capture_id", "server_ip"]
    hosts = sessions.groupBy(*key).agg(
        F.count("*").alias("sessions"), _words("protocol").alias("protocols"),
        _words("handshake.tls_version").alias("tls_versions"),
    )
    found = findings.groupBy(*key).agg(
        F.count("*").alias("findings_count"), F.max(labels.severity_rank("severity")).alias("worst")
    )
    return hosts.join(found, key, "left").select(
        "capture_id", ids.host_id("server_ip").alias("host_id"), F.col("server_ip").alias("ip"), "sessions", "protocols",
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
        labels.severity_of_rank("worst").alias("highest_severity"),
        F.col("worst").isNotNull().alias("affected"), "tls_versions",
    )


def posture_protocols(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    key = ["capture_id", "protocol"]
    known = F.col("protocol").isNotNull()
    base = sessions.where(known).groupBy(*key).agg(F.count("*").alias("sessions"))
    found = findings.where(known).groupBy(*key).agg(
        F.count("*").alias("findings"), F.countDistinct("session_id").alias("affected_sessions"),
        F.max(labels.severity_rank("severity")).alias("worst"),
    )
    return base.join(found, key, "left").select(
        *key, "sessions", F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("affected_sessions", F.lit(0)).alias("affected_sessions"),
        labels.factor_status("worst").alias("status"),
    )


def posture_priorities(hits: DataFrame) -> DataFrame:
    """Finding groups by rule, ranked by priority score; prevalence is per rule here."""
    key = ["capture_id", "rule_id"]
    per_rule = conditions(hits).groupBy(*key, "total_sessions").agg(
        _dominant().alias("dominant"), F.sum("evidence_count").alias("evidence_count"),
        F.sum("findings").alias("findings"),
    )
    rows = (
        per_rule.join(affected(hits, "rule_id", "first_in_rule"), key)
        .withColumns({"severity": F.col("dominant.severity"), "confidence": F.col("dominant.confidence"), "title": F.col("dominant.first.title")})
        .withColumn("prevalence_e4", half_even(F.least("affected_sessions", "total_sessions") * 10000, F.col("total_sessions")))
        .withColumn("priority_cents", half_even(_quarters() * (F.col("prevalence_e4") + 10000), 800))
    )
    text = F.concat(
        "severity", F.lit(" severity affecting "), F.col("affected_sessions").cast("string"), F.lit("/"),
        F.col("total_sessions").cast("string"), F.lit(" session(s) ("),
        half_even(F.col("prevalence_e4"), 100).cast("string"), F.lit("% prevalence) across "),
        F.col("affected_hosts").cast("string"), F.lit(" host(s) with "), "confidence", F.lit(" evidence confidence"),
    )
    rank = F.row_number().over(W.partitionBy("capture_id").orderBy(F.col("priority_cents").desc(), "rule_id"))
    return rows.select(
        "capture_id", rank.cast("bigint").alias("position"), "priority_cents", "rule_id", "title", "severity", "confidence",
        "affected_sessions", "total_sessions", "prevalence_e4", "affected_hosts", "evidence_count", "findings",
        text.alias("explanation"),
    )


def posture_explanation(factors: DataFrame, priorities: DataFrame) -> DataFrame:
    """Ordered text lines: contributing factors by size, then the top three priorities."""
    order = W.partitionBy("capture_id").orderBy(F.col("contribution_cents").desc(), "factor")
    total = F.col("total_sessions").cast("string")
    factor_lines = factors.where(F.col("contribution_cents") > 0).select(
        "capture_id", F.lit(0).alias("part"), F.row_number().over(order).alias("n"),
        F.concat(
            "label", F.lit(": "), "status", F.lit(" — "), F.col("affected_sessions").cast("string"), F.lit("/"), total,
            F.lit(" session(s) affected (-"), cents_text(F.col("contribution_cents")), F.lit(" points)"),
        ).alias("line"),
    )
    priority_lines = priorities.where(F.col("position") <= 3).select(
        "capture_id", F.lit(1).alias("part"), F.col("position").cast("int").alias("n"),
        F.concat(F.lit("Priority "), F.col("position").cast("string"), F.lit(": "), "title", F.lit(" ("), "explanation", F.lit(")")).alias("line"),
    )
    lines = factor_lines.unionByName(priority_lines)
    # At most five factor lines and three priorities per capture: a bounded list.
    listed = lines.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "line"))).alias("l"))
    text = F.transform("l", lambda s: s["line"])
    every = factors.select("capture_id").distinct()
    nothing = F.array(F.lit("No policy violations observed in the analyzed sessions."))
    return every.join(listed, "capture_id", "left").select(
        "capture_id", F.coalesce(text, nothing).alias("explanation")
    )


def evidence_time(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Latest evidence instant per capture: detection or session end."""
    times = findings.select("capture_id", F.col("detected_at").alias("at")).unionByName(
        sessions.select("capture_id", F.col("ended_at").alias("at"))
    )
    return times.groupBy("capture_id").agg(F.max("at").alias("generated_at"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id", "severity").agg(F.count("*").alias("findings"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id", "category").agg(F.count("*").alias("findings"))


def rule_max_severity(findings: DataFrame) -> DataFrame:
    worst = findings.groupBy("capture_id", "rule_id").agg(F.max(labels.severity_rank("severity")).alias("rank"))
    return worst.select("capture_id", "rule_id", labels.severity_of_rank("rank").alias("severity"))


def posture_snapshot(captures: DataFrame, hits: DataFrame, policy) -> DataFrame:
    """One posture row per capture; a capture without sessions has insufficient evidence."""
    score = posture_score(posture_factors(hits)).select("capture_id", "overall_score", "posture_state")
    # detected_at is the session end (or start), so it already covers both evidence instants.
    latest = hits.groupBy("capture_id").agg(F.max("detected_at").alias("generated_at"))
    rows = (
        captures.select("capture_id")
        .join(session_totals(hits), "capture_id", "left")
        .join(score, "capture_id", "left")
        .join(posture_confidence(hits), "capture_id", "left")
        .join(latest, "capture_id", "left")
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.select(
        "capture_id", F.lit(policy.id).alias("policy_id"), F.lit(policy.version).alias("policy_version"),
        F.coalesce("posture_state", F.lit(V.NO_SESSIONS_STATE)).alias("posture_state"), "overall_score",
        F.coalesce("confidence", F.lit("low")).alias("confidence"),
        zero("total_sessions"), zero("affected_sessions"), zero("affected_hosts"), zero("total_hosts"),
        "generated_at",
    )
