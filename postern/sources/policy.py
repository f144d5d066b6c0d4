"""Evaluation policy: typed thresholds, loadable from a JSON document."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postern.functions.fixed_values import DEPRECATED_TLS_VERSIONS, MAX_POLICY_BYTES


@dataclass(frozen=True)
class TlsPolicy:
    minimum_version: str = "TLS 1.2"
    deprecated_versions: tuple[str, ...] = DEPRECATED_TLS_VERSIONS


@dataclass(frozen=True)
class CipherSuitePolicy:
    finding_classes: tuple[str, ...] = ("prohibited", "deprecated", "legacy")


@dataclass(frozen=True)
class KeyExchangePolicy:
    prohibited: tuple[str, ...] = ("rsa", "dh", "ecdh")


@dataclass(frozen=True)
class CertificatePolicy:
    minimum_rsa_bits: int = 2048
    minimum_dsa_bits: int = 2048
    minimum_ec_bits: int = 256
    weak_signature_algorithms: tuple[str, ...] = ("md5", "sha1")
    require_san_match_when_evidence_allows: bool = True
    warn_on_self_signed: bool = True


@dataclass(frozen=True)
class ForwardSecrecyPolicy:
    required: bool = True


@dataclass(frozen=True)
class Policy:
    id: str = "baseline"
    version: str = "1.0"
    tls: TlsPolicy = field(default_factory=TlsPolicy)
    cipher_suites: CipherSuitePolicy = field(default_factory=CipherSuitePolicy)
    key_exchange: KeyExchangePolicy = field(default_factory=KeyExchangePolicy)
    certificates: CertificatePolicy = field(default_factory=CertificatePolicy)
    forward_secrecy: ForwardSecrecyPolicy = field(default_factory=ForwardSecrecyPolicy)


SECTIONS = {f.name: f.default_factory for f in fields(Policy) if f.name not in ("id", "version")}
SQL_TYPES = {str: "string", int: "int", bool: "boolean", tuple: "array<string>"}


def _section_ddl(section) -> str:
    inner = ", ".join(f"{f.name}: {SQL_TYPES[type(getattr(section(), f.name))]}" for f in fields(section))
    return f"struct<{inner}>"


POLICY_DDL = "id string, version string, " + ", ".join(f"{n} {_section_ddl(s)}" for n, s in SECTIONS.items())


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Read one policy document (at most 1 MB); unknown keys and wrong types are rejected.

    The document is configuration: one bounded row reaches the driver, where it
    becomes literals of the rule expressions.
    """
    text = F.col("value")
    document = spark.read.text(path, wholetext=True)
    unknown = [F.array_except(F.coalesce(F.json_object_keys(text), F.array()), F.array(*map(F.lit, ["id", "version", *SECTIONS])))]
    for name, section in SECTIONS.items():
        keys = F.json_object_keys(F.get_json_object(text, f"$.{name}"))
        unknown.append(F.array_except(F.coalesce(keys, F.array()), F.array(*[F.lit(f.name) for f in fields(section)])))
    checked = document.select(
        F.length(text).alias("size"),
        F.flatten(F.array(*unknown)).alias("unknown"),
        F.when(
            (F.length(text) <= MAX_POLICY_BYTES),
            F.from_json(text, POLICY_DDL, {"mode": "FAILFAST"}),
        ).alias("policy"),
    )
    try:
        row = checked.first()
    except Exception as error:
        raise ValueError(f"policy failed validation ({path}): {error}") from error
    if row["size"] > MAX_POLICY_BYTES:
        raise ValueError(f"policy document exceeds {MAX_POLICY_BYTES} bytes: {path}")
    if row["unknown"] or row["policy"] is None:
        raise ValueError(f"policy failed validation ({path}): unknown keys {row['unknown']}")
    given = row["policy"]
    values = {k: given[k] for k in ("id", "version") if given[k] is not None}
    for name, section in SECTIONS.items():
        part = given[name]
        if part is not None:
            kept = {f.name: part[f.name] for f in fields(section) if part[f.name] is not None}
            values[name] = section(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()})
    return Policy(**values)
