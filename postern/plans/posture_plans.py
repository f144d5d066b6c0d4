"""Queries over posture."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern.functions.columns import iso_text
from postern.operators import posture, rules
from postern.plans.base import query


@query("condition_prevalence")
def condition_prevalence(w):
    return posture.condition_prevalence(w.hits)


@query("finding_deduction")
def finding_deduction(w):
    return posture.finding_deduction(w.hits).select(
        "finding_id", "capture_id", "rule_id", "observed_value", "affected_sessions", "total_sessions", "deduction_cents",
        "factor", (F.col("deduction_cents") / 100).alias("deduction"),
    )


@query("posture_factors")
def posture_factors(w):
    return posture.posture_factors(w.hits).withColumn("score_contribution", F.col("contribution_cents") / 100)


@query("posture_factor_findings")
def posture_factor_findings(w):
    return posture.factor_findings(w.hits)


@query("posture_score")
def posture_score(w):
    return posture.posture_score(posture.posture_factors(w.hits))


@query("posture_confidence")
def posture_confidence(w):
    return posture.posture_confidence(w.hits)


@query("posture_hosts")
def posture_hosts(w):
    return posture.posture_hosts(w.sessions, w.findings)


@query("posture_protocols")
def posture_protocols(w):
    return posture.posture_protocols(w.sessions, w.findings)


@query("posture_priorities")
def posture_priorities(w):
    return w.priorities.withColumns(
        {"prevalence": F.col("prevalence_e4") / 10000, "priority_score": F.col("priority_cents") / 100}
    )


@query("posture_explanation")
def posture_explanation(w):
    lines = posture.posture_explanation(w.factors, w.priorities)
    return lines.select("capture_id", F.array_join("explanation", "\n").alias("explanation"))


@query("posture_snapshot")
def posture_snapshot(w):
    return posture.posture_snapshot(w.captures, w.hits, w.policy).withColumn("generated_at", iso_text("generated_at"))


@query("severity_counts")
def severity_counts(w):
    return posture.severity_counts(w.findings)


@query("category_counts")
def category_counts(w):
    return posture.category_counts(w.findings)


@query("evidence_time")
def evidence_time(w):
    return posture.evidence_time(w.findings, w.sessions).select("capture_id", iso_text("generated_at").alias("generated_at"))


@query("rule_max_severity")
def rule_max_severity(w):
    return posture.rule_max_severity(w.findings)


@query("posture_score_from_stored_findings")
def posture_score_from_stored_findings(w):
    """The same score when only the findings table is stored: nest it by session first."""
    return posture.posture_score(posture.posture_factors(rules.nest(w.findings, w.sessions)))
