"""Deterministic identifiers, all prefixes of SHA-256 over canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postern.functions.columns import col, joined, prefixed_sha
from postern.functions.fixed_values import ID_SHAPES


def capture_id(sha256: str | Column) -> Column:
    return F.concat(F.lit("capture_"), F.substring(col(sha256), 1, 12))


def session_id(capture: str | Column, flow: str | Column) -> Column:
    return prefixed_sha("session_", joined(capture, flow), 16)


def finding_id(rule: Column, session: Column, observed: Column, extra: Column) -> Column:
    return prefixed_sha("finding_", joined(rule, session, observed, extra), 12)


def anomaly_id(session: str | Column) -> Column:
    return prefixed_sha("anomaly_", col(session), 12)


def host_id(ip: str | Column) -> Column:
    return prefixed_sha("host_", col(ip), 12)


def tls_handshake_id(session: str | Column) -> Column:
    return prefixed_sha("tls_", col(session), 12)


def drift_id(case: Column, baseline: Column, comparison: Column, kind: Column, key: Column) -> Column:
    return prefixed_sha("drift_", joined(case, baseline, comparison, kind, key), 16)


def observation_id(case: Column, capture: Column, digest: Column) -> Column:
    return prefixed_sha("obs_", joined(case, capture, digest), 16)


def tls_config_fingerprint(version: Column, cipher: Column, key_exchange: Column) -> Column:
    """Fingerprint of a negotiated configuration.

    Graph and drift pass the raw values, correlation passes normalised
    lower-case tokens; the two therefore differ for one configuration.
    """
    return prefixed_sha("tlscfg_", joined(version, cipher, key_exchange), 12)


def node_id(prefix: str, *parts: str | Column) -> Column:
    return prefixed_sha(prefix, joined(*parts), 12)


def capture_node(capture): return node_id("capture_", capture)
def host_node(ip): return node_id("host_", ip)
def endpoint_node(ip, port): return node_id("endpoint_", ip, port)
def session_node(session): return node_id("snode_", session)
def protocol_node(protocol): return node_id("protocol_", protocol)
def handshake_node(session): return node_id("tlshk_", session)
def certificate_node(fingerprint): return node_id("gcert_", fingerprint)
def tls_config_node(fingerprint): return node_id("tlscfg_", fingerprint)
def finding_node(finding): return node_id("fnode_", finding)
def anomaly_node(anomaly): return node_id("anode_", anomaly)
def posture_node(factor, capture): return node_id("pfactor_", factor, capture)
def event_node(session, seq): return node_id("event_", session, seq)


def id_shape_valid(kind: str, value: str | Column) -> Column:
    return F.coalesce(col(value).rlike(ID_SHAPES[kind]), F.lit(False))
