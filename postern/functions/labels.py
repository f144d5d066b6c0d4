"""Vocabulary lookups and threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postern.functions import fixed_values as V
from postern.functions.columns import case_map, col, threshold_label


def cipher_suite_name(code: str | Column) -> Column:
    c = col(code)
    return F.when(c.isNotNull(), case_map(c, V.CIPHER_SUITE_NAMES, F.format_string("0x%04X", c)))


def cipher_class(code: str | Column) -> Column:
    by_code = {code: name for name, codes in V.CIPHER_CLASS_CODES.items() for code in codes}
    return case_map(col(code), by_code, "unknown")


def key_exchange_for_suite(name: str | Column) -> Column:
    n = col(name)
    out = None
    for prefix, family in V.KEY_EXCHANGE_PREFIXES:
        test = n.startswith(prefix)
        out = F.when(test, family) if out is None else out.when(test, family)
    return out.otherwise("unknown")


def tls_version_name(code: str | Column) -> Column:
    return case_map(col(code), V.TLS_VERSION_CODES, "unknown")


def tls_version_rank(version: str | Column) -> Column:
    return case_map(col(version), {v: i for i, v in enumerate(V.TLS_VERSION_ORDER)})


def deprecated_version(version: str | Column) -> Column:
    return F.coalesce(col(version).isin(*V.DEPRECATED_TLS_VERSIONS), F.lit(False))


def forward_secret(key_exchange: str | Column) -> Column:
    return F.coalesce(col(key_exchange).isin(*V.FORWARD_SECRET_KEY_EXCHANGES), F.lit(False))


def certificate_expired(not_after: str | Column, as_of: str | Column) -> Column:
    return col(as_of) > col(not_after)


def port_protocol(port: str | Column) -> Column:
    return case_map(col(port), V.PORT_PROTOCOLS)


def implicit_tls_port(port: str | Column) -> Column:
    return F.coalesce(col(port).isin(*V.IMPLICIT_TLS_PORTS), F.lit(False))


def tcp_flags_label(flags: str | Column) -> Column:
    f = col(flags)
    names = F.array_compact(F.array(*[F.when(f.bitwiseAND(bit) != 0, F.lit(n)) for bit, n in V.TCP_FLAGS]))
    return F.when(F.size(names) == 0, F.lit("none")).otherwise(F.array_join(names, "+"))


def severity_weight(severity: str | Column) -> Column:
    return case_map(col(severity), V.SEVERITY_WEIGHTS, 0)


def severity_rank(severity: str | Column) -> Column:
    return case_map(col(severity), V.SEVERITY_RANKS, -1)


def severity_of_rank(rank: str | Column) -> Column:
    return case_map(col(rank), {r: s for s, r in V.SEVERITY_RANKS.items()})


def severity_position(severity: str | Column) -> Column:
    """0 for the most severe, 99 for an unknown word."""
    return case_map(col(severity), {s: i for i, s in enumerate(V.SEVERITY_ORDER)}, 99)


def confidence_quarters(confidence: str | Column) -> Column:
    return case_map(col(confidence), V.CONFIDENCE_QUARTERS, V.DEFAULT_CONFIDENCE_QUARTERS)


def confidence_rank(confidence: str | Column) -> Column:
    return case_map(col(confidence), V.CONFIDENCE_RANKS, 0)


def confidence_of_rank(rank: str | Column) -> Column:
    return case_map(col(rank), {r: c for c, r in V.CONFIDENCE_RANKS.items()}, "unknown")


def factor_of_rule(rule: str | Column) -> Column:
    return case_map(col(rule), V.FACTOR_BY_RULE, "other")


def factor_status(worst_rank: str | Column) -> Column:
    by_rank = {V.SEVERITY_RANKS[s]: status for s, status in V.FACTOR_STATUS_BY_SEVERITY.items()}
    return case_map(col(worst_rank), by_rank, "ok")


def posture_state(score: str | Column) -> Column:
    return threshold_label(col(score), V.POSTURE_BANDS, V.LOWEST_POSTURE_BAND)


def anomaly_band(score: str | Column) -> Column:
    return threshold_label(col(score), V.ANOMALY_BANDS, "normal")


def anomaly_score(decision: str | Column) -> Column:
    return F.bround(100 / (1 + F.exp(col(decision) * 20)), 0).cast("int")


def deviation_label(score: str | Column) -> Column:
    return threshold_label(col(score), ((1.0, "high"), (0.5, "moderate")), "low")


def safe_number(value: str | Column) -> Column:
    v = col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    clamped = F.greatest(F.lit(-V.NUMERIC_CLAMP), F.least(F.lit(V.NUMERIC_CLAMP), v))
    return F.when(usable, clamped).otherwise(F.lit(0.0))


def vocabulary_index(feature: str, value: str | Column) -> Column:
    words = V.CATEGORICAL_VOCABULARIES[feature]
    return case_map(col(value), {w: i for i, w in enumerate(words)}, len(words) - 1)


def vocabulary_label(feature: str, index: str | Column) -> Column:
    words = V.CATEGORICAL_VOCABULARIES[feature]
    return case_map(col(index).cast("int"), dict(enumerate(words)), "other")


def endpoint_label(protocol, ip, port) -> Column:
    return F.concat_ws("|", F.coalesce(col(protocol), F.lit("unknown")), col(ip), col(port).cast("string"))


def _bit(value: Column) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0)).cast("string")


def starttls_state(starttls: str | Column) -> Column:
    s = col(starttls)
    text = F.concat(
        F.lit("adv="), _bit(s["advertised"]), F.lit(":req="), _bit(s["requested"]),
        F.lit(":resp="), _bit(s["response_seen"]),
    )
    return F.when(s.isNull(), F.lit("none")).otherwise(text)


def python_bool_text(value: str | Column) -> Column:
    v = col(value)
    return F.when(v, F.lit("True")).when(~v, F.lit("False")).otherwise(F.lit("None"))


def link_type_name(code: str | Column) -> Column:
    c = col(code)
    return case_map(c, V.LINK_TYPE_NAMES, F.concat(F.lit("linktype "), c.cast("string")))
