"""Queries over rules and findings."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.functions import ids, labels
from postern.functions.columns import iso_text
from postern.functions.fixed_values import FACTOR_BY_RULE
from postern.operators import rules
from postern.plans.base import query
from postern.sources.policy import CertificatePolicy, Policy, TlsPolicy

RULE_QUERIES = {
    "rule_tls_version": "TLS-VERSION-001",
    "rule_cipher_selected": "CIPHER-SELECTED-001",
    "rule_cipher_unknown": "CIPHER-UNKNOWN-001",
    "rule_key_exchange": "KEYEX-001",
    "rule_forward_secrecy": "FS-001",
    "rule_cert_validity": "CERT-VALIDITY-001",
    "rule_cert_key": "CERT-KEY-001",
    "rule_cert_signature": "CERT-SIG-001",
    "rule_cert_identity": "CERT-IDENTITY-001",
    "rule_cert_chain": "CERT-CHAIN-001",
    "rule_cert_self_signed": "CERT-SELF-SIGNED-001",
    "rule_starttls": "STARTTLS-001",
    "rule_auth_plaintext": "AUTH-PLAINTEXT-001",
    "rule_tls_failure": "TLS-FAILURE-001",
    "rule_plaintext_session": "PLAINTEXT-001",
}
OVERRIDE = Policy(
    tls=TlsPolicy(minimum_version="TLS 1.3"), certificates=CertificatePolicy(minimum_rsa_bits=4096)
)


def flat(findings: DataFrame) -> DataFrame:
    """Findings with scalar columns only."""
    return findings.select(
        "finding_id", "capture_id", "session_id", "protocol", "server_ip", "rule_id", "title", "severity", "confidence",
        "category", "observed_value", "expected_value", F.col("remediation.action").alias("action"),
        F.col("remediation.target").alias("target"), F.col("remediation.rationale").alias("rationale"),
        F.col("remediation.priority").alias("priority"), F.col("standard_reference.name").alias("standard_name"),
        F.size("evidence_refs").cast("bigint").alias("n_refs"),
        "first_packet", "last_packet", iso_text("detected_at").alias("detected_at"),
    )


def _register(name: str, rule_id: str) -> None:
    @query(name)
    def run(w):
        events = w.session_events if rule_id == "AUTH-PLAINTEXT-001" else None
        return flat(rules.evaluate(w.sessions, events, w.policy, rules.default_registry().only(rule_id)))


for _name, _rule in RULE_QUERIES.items():
    _register(_name, _rule)


@query("evaluate_all_rules")
def evaluate_all_rules(w):
    return flat(rules.evaluate(w.sessions, w.session_events, w.policy))


@query("finding_id")
def finding_id(w):
    f = w.findings
    return f.select(
        "finding_id", "rule_id", "session_id", ids.id_shape_valid("session", "session_id").alias("session_shape_valid")
    )


@query("policy_override")
def policy_override(w):
    """Findings under other thresholds: TLS 1.3 minimum and RSA 4096."""
    return flat(rules.evaluate(w.sessions, w.session_events, OVERRIDE))


@query("rule_registry")
def rule_registry(w):
    """An extra rule registered next to the built-in ones: very large server payloads."""

    def bulky(_):
        out = rules.finding(
            "BULK-001", "large", "info", "low", F.col("bytes_server_to_client").cast("string"),
            F.expr("cast(array() as array<struct<source:string,packet_numbers:array<int>,detail:string>>)"),
        )
        return F.when(F.col("bytes_server_to_client") > 50_000, out)

    registry = rules.default_registry().only("PLAINTEXT-001")
    registry.register(
        "BULK-001", bulky,
        (("BULK-001", "large", "Large server payload", "other", None, None, None, None, None, None, None),),
    )
    return flat(rules.evaluate(w.sessions, None, w.policy, registry))


@query("evidence_flags")
def evidence_flags(w):
    """forward_secrecy_flag, deprecated_version_flag and cert_is_expired per session."""
    leaf = rules.leaf()
    return w.sessions.select(
        "session_id", labels.forward_secret("handshake.key_exchange").alias("forward_secrecy_flag"),
        labels.deprecated_version("handshake.tls_version").alias("deprecated_version_flag"),
        labels.certificate_expired(leaf["not_after"], "started_at").alias("cert_is_expired"),
    )
