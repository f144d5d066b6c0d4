"""Policy rules: one row-local pass over sessions producing findings.

Each rule is a function ``policy -> Column`` giving a compact finding struct or
NULL. All rules of a registry are evaluated side by side on one scan, the
non-NULL structs are exploded, and the constant texts are attached from a
constant relation of a few dozen rows. No rule needs a shuffle: sessions carry
their presented chain as a nested array, and the only joined input is the
per-session summary of plaintext authentication commands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import fixed_values as V
from postern.functions import ids, labels
from postern.functions.columns import case_map, iso_text, literal_table, memo
from postern.sources.policy import Policy




def _hs(name: str) -> Column:
    return F.col(f"handshake.{name}")


def leaf() -> Column:
    """The first presented certificate at chain position 0, or NULL."""
    at_zero = F.filter("certificates", lambda c: c["position_in_chain"] == 0)
    return F.get(at_zero, F.lit(0))


def _ref(source: str | Column, packets: Column, detail: Column) -> Column:
    return F.struct(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        packets.alias("packet_numbers"),
        detail.alias("detail"),
    )





def _none() -> Column:
    return F.expr("cast(array() as array<int>)")


def _packets(name: str) -> Column:
    return F.coalesce(_hs(name), _none())


def _certificate_ref(certificate: Column) -> Column:
    position = F.coalesce(certificate["position_in_chain"], F.lit(0)).cast("string")
    return _ref(
        F.concat(F.lit("Certificate("), position, F.lit(")")), _none(),
        F.concat(F.lit("subject "), certificate["subject"]),
    )


def finding(rule, variant, severity, confidence, observed, refs, *, extra="", expected=None, detail=None) -> Column:
    """The compact struct every rule returns."""
    lit = lambda v: F.lit(v) if not isinstance(v, Column) else v
    return F.struct(
        F.lit(rule).alias("rule_id"),
        lit(variant).alias("variant"),
        lit(severity).alias("severity"),
        lit(confidence).alias("confidence"),
        lit(observed).alias("observed_value"),
        lit(extra).alias("extra"),
        lit(expected).cast("string").alias("own_expected"),
        (lit(observed) if detail is None else lit(detail)).alias("detail"),
        refs.alias("evidence_refs"),
    )


def _confidence() -> Column:
    return F.when(_hs("handshake_complete"), "high").otherwise("medium")


def _server_hello(detail: Column) -> Column:
    return F.array(_ref("ServerHello", _packets("server_hello_packets"), detail))


def tls_version(policy: Policy) -> Column:
    version = _hs("tls_version")
    rank, minimum = labels.tls_version_rank(version), policy.tls.minimum_version
    minimum_rank = V.TLS_VERSION_ORDER.index(minimum) if minimum in V.TLS_VERSION_ORDER else None
    if minimum_rank is None:
        return F.lit(None)
    deprecated = version.isin(*policy.tls.deprecated_versions) & rank.isNotNull()
    severity = (
        F.when(deprecated & version.isin(*V.BROKEN_TLS_VERSIONS), "critical").when(deprecated, "high").otherwise("low")
    )
    out = finding(
        "TLS-VERSION-001", F.when(deprecated, "deprecated").otherwise("below-minimum"), severity, _confidence(),
        version, _server_hello(F.concat(F.lit("negotiated "), version)),
    )
    return F.when(deprecated | (rank < minimum_rank), out)


def cipher_selected(policy: Policy) -> Column:
    kind = labels.cipher_class(_hs("cipher_suite_code"))
    severity = (
        F.when(kind == "prohibited", "critical").when(kind == "deprecated", "medium").when(kind == "legacy", "low")
        .otherwise("medium")
    )
    suite = F.coalesce(_hs("cipher_suite"), F.lit(""))
    out = finding(
        "CIPHER-SELECTED-001", kind, severity, _confidence(), suite,
        _server_hello(F.concat(F.lit("selected suite "), suite)),
        detail=F.concat(suite, F.lit(" is "), kind),
    )
    return F.when(_hs("cipher_suite_code").isNotNull() & kind.isin(*policy.cipher_suites.finding_classes), out)


def cipher_unknown(_: Policy) -> Column:
    code = _hs("cipher_suite_code")
    suite = F.coalesce(_hs("cipher_suite"), F.lit(""))
    out = finding(
        "CIPHER-UNKNOWN-001", "unregistered", "info", "medium", suite,
        _server_hello(F.concat(F.lit("selected suite "), suite)),
    )
    return F.when(code.isNotNull() & (labels.cipher_class(code) == "unknown"), out)


def key_exchange(policy: Policy) -> Column:
    family = _hs("key_exchange")
    out = finding(
        "KEYEX-001", "prohibited", "medium", _confidence(), family,
        _server_hello(F.concat(F.lit("key exchange "), family)),
    )
    return F.when((family != "unknown") & family.isin(*policy.key_exchange.prohibited), out)


def forward_secrecy(_: Policy) -> Column:
    out = finding(
        "FS-001", "undetermined", "info", "low", "unknown", _server_hello(F.lit("key exchange undetermined"))
    )
    return F.when(F.col("handshake").isNotNull() & (_hs("key_exchange") == "unknown"), out)


def certificate_validity(_: Policy) -> Column:
    cert, at = F.col("leaf"), F.col("started_at")
    expired, early = at > cert["not_after"], at < cert["not_before"]
    observed = F.when(expired, F.concat(F.lit("valid until "), iso_text(cert["not_after"]))).otherwise(
        F.concat(F.lit("valid from "), iso_text(cert["not_before"]))
    )
    variant = F.when(expired, "expired_at_capture").otherwise("not_yet_valid_at_capture")
    out = finding(
        "CERT-VALIDITY-001", variant, F.when(expired, "high").otherwise("medium"), "high", observed,
        F.array(_certificate_ref(cert)), extra=variant,
    )
    return F.when(expired | early, out)


def certificate_key(policy: Policy) -> Column:
    cert, p = F.col("leaf"), policy.certificates
    algorithm, bits = cert["public_key_algorithm"], cert["public_key_size_bits"]
    minimum = (
        F.when(algorithm == "RSA", p.minimum_rsa_bits).when(algorithm == "DSA", p.minimum_dsa_bits)
        .when(algorithm == "EC", p.minimum_ec_bits)
    )
    judged = minimum.isNotNull() & bits.isNotNull()
    size = F.coalesce(bits.cast("string"), F.lit(""))
    observed = F.when(judged, F.concat(algorithm, F.lit(" "), size, F.lit(" bits"))).otherwise(
        F.trim(F.concat(algorithm, F.lit(" "), size))
    )
    out = finding(
        "CERT-KEY-001", F.when(judged, "weak").otherwise("not-covered"), F.when(judged, "high").otherwise("info"),
        "high", observed, F.array(_certificate_ref(cert)),
        expected=F.when(judged, F.concat(algorithm, F.lit(" at least "), minimum.cast("string"), F.lit(" bits"))),
    )
    return F.when(algorithm.isNotNull() & (~judged | (bits < minimum)), out)


def certificate_signature(policy: Policy) -> Column:
    cert = F.col("leaf")
    algorithm = F.lower(cert["signature_algorithm"])
    hit = F.coalesce(*[F.when(algorithm.contains(w), F.lit(w)) for w in policy.certificates.weak_signature_algorithms], F.lit(None).cast("string"))
    out = finding(
        "CERT-SIG-001", "weak", F.when(hit == "md5", "critical").otherwise("high"), "high",
        cert["signature_algorithm"], F.array(_certificate_ref(cert)),
    )
    return F.when(hit.isNotNull(), out)


def san_covers(sni: Column, san: Column) -> Column:
    """Exact match, or a '*.' / '.' suffix match at any depth; case-insensitive."""
    pattern, name = F.ltrim(F.lower(san), F.lit("*")), F.lower(sni)
    return F.when(pattern.startswith("."), name.endswith(pattern) & (name != pattern)).otherwise(name == pattern)


def certificate_identity(policy: Policy) -> Column:
    if not policy.certificates.require_san_match_when_evidence_allows:
        return F.lit(None)
    cert, sni = F.col("leaf"), _hs("sni_server_name")
    sans = cert["subject_alternative_names"]
    observed = F.concat(F.lit("SNI "), sni, F.lit(" vs SANs "), F.array_join(sans, ", "))
    refs = F.array(
        _certificate_ref(cert), _ref("ClientHello", _packets("client_hello_packets"), F.concat(F.lit("SNI "), sni))
    )
    out = finding("CERT-IDENTITY-001", "mismatch", "high", "high", observed, refs)
    return F.when((sni != "") & (F.size(sans) > 0) & ~F.exists(sans, lambda san: san_covers(sni, san)), out)


def certificate_chain(_: Policy) -> Column:
    cert, chain = F.col("leaf"), F.col("certificates")
    others = F.transform(
        F.filter(chain, lambda c: ~F.coalesce(c["position_in_chain"] == 0, F.lit(False))), lambda c: c["subject"]
    )
    self_issued = cert["subject"] == cert["issuer"]
    missing = ~self_issued & ~F.coalesce(F.array_contains(others, cert["issuer"]), F.lit(False))
    observed = F.when(missing, F.concat(F.lit("issuer '"), cert["issuer"], F.lit("' not observed"))).otherwise(
        F.lit("self-issued leaf with a non-empty chain")
    )
    refs = F.when(missing, F.array(_certificate_ref(cert))).otherwise(F.transform(chain, _certificate_ref))
    out = finding(
        "CERT-CHAIN-001", F.when(missing, "incomplete").otherwise("inconsistent"),
        F.when(missing, "info").otherwise("medium"), F.when(missing, "high").otherwise("medium"), observed, refs,
    )
    return F.when(missing | (self_issued & (F.size(chain) > 1)), out)


def certificate_self_signed(policy: Policy) -> Column:
    if not policy.certificates.warn_on_self_signed:
        return F.lit(None)
    cert = F.col("leaf")
    out = finding(
        "CERT-SELF-SIGNED-001", "self-signed", "low", "high", "self-signed certificate",
        F.array(_certificate_ref(cert)), detail=cert["subject"],
    )
    return F.when(cert["subject"] == cert["issuer"], out)


def _implicit() -> Column:
    return F.coalesce(F.col("implicit_tls"), F.lit(False))


def starttls(_: Policy) -> Column:
    s = F.col("starttls")
    advertised, requested, accepted = (F.coalesce(s[n], F.lit(False)) for n in ("advertised", "requested", "response_seen"))
    no_hello = F.coalesce(F.size(_hs("client_hello_packets")) <= 0, F.lit(True))
    packets = F.when(F.coalesce(s["packet_number"], F.lit(0)) != 0, F.array(s["packet_number"].cast("int"))).otherwise(_none())
    step = (
        F.when(advertised & ~requested, 1).when(requested & ~accepted, 2).when(accepted & no_hello, 3)
    )
    choose = lambda a, b, c: F.when(step == 1, a).when(step == 2, b).otherwise(c)
    variant = choose("advertised-not-requested", "requested-not-accepted", "accepted-no-handshake")
    out = finding(
        "STARTTLS-001", variant, "medium", choose("high", "high", "medium"),
        choose(
            "STARTTLS advertised; no request observed", "STARTTLS requested; no acceptance observed",
            "no TLS handshake after acceptance",
        ),
        F.array(
            _ref(
                "STARTTLS negotiation", packets,
                choose("advertised, not requested", "requested, no acceptance observed", "accepted; no handshake observed"),
            )
        ),
        extra=variant,
    )
    return F.when(~_implicit() & s.isNotNull() & step.isNotNull(), out)


def auth_plaintext(_: Policy) -> Column:
    commands = F.col("auth_commands")
    ref = _ref(
        "SessionEvents", F.array_compact(F.array("auth_first_packet", "auth_last_packet")),
        F.concat(F.lit("authentication commands: "), commands),
    )
    return F.when(
        commands.isNotNull(), finding("AUTH-PLAINTEXT-001", "observed", "high", "high", commands, F.array(ref))
    )


def tls_failure(_: Policy) -> Column:
    out = finding(
        "TLS-FAILURE-001", "incomplete", "info", "medium", "incomplete TLS handshake",
        F.array(_ref("ClientHello", _packets("client_hello_packets"), F.lit("handshake began"))),
        detail=F.coalesce(_hs("completeness_reason"), F.lit("reason unknown")),
    )
    return F.when(_hs("handshake_complete") == False, out)  # noqa: E712  (NULL is not FALSE)


def plaintext_session(_: Policy) -> Column:
    accepted = F.coalesce(F.col("starttls.response_seen"), F.lit(False))
    out = finding(
        "PLAINTEXT-001", "no-tls", "medium", "high", "no TLS",
        F.array(_ref("SessionEvents", _none(), F.lit("no TLS records or STARTTLS transition observed"))),
    )
    return F.when(F.col("protocol").isNotNull() & ~_implicit() & F.col("handshake").isNull() & ~accepted, out)


RuleBuilder = Callable[[Policy], Column]


class RuleRegistry:
    """Ordered rules; extend it with any ``policy -> Column`` built from :func:`finding`."""

    def __init__(self) -> None:
        self._rules: list[tuple[str, RuleBuilder]] = []
        self._texts: list[tuple] = list(V.FINDING_TEXTS)

    def register(self, rule_id: str, build: RuleBuilder, texts: tuple[tuple, ...] = ()) -> RuleRegistry:
        self._rules.append((rule_id, build))
        self._texts.extend(texts)
        return self

    def rule_ids(self) -> list[str]:
        return [rule_id for rule_id, _ in self._rules]

    def only(self, *rule_ids: str) -> RuleRegistry:
        picked = RuleRegistry()
        picked._texts = self._texts
        picked._rules = [r for r in self._rules if r[0] in rule_ids]
        return picked

    def rules(self) -> list[tuple[str, RuleBuilder]]:
        return self._rules

    def columns(self, policy: Policy) -> list[Column]:
        return [build(policy) for _, build in self._rules]

    def texts(self) -> list[tuple]:
        return self._texts


def default_registry() -> RuleRegistry:
    registry = RuleRegistry()
    for rule_id, build in (
        ("TLS-VERSION-001", tls_version),
        ("CIPHER-SELECTED-001", cipher_selected),
        ("CIPHER-UNKNOWN-001", cipher_unknown),
        ("KEYEX-001", key_exchange),
        ("FS-001", forward_secrecy),
        ("CERT-VALIDITY-001", certificate_validity),
        ("CERT-KEY-001", certificate_key),
        ("CERT-SIG-001", certificate_signature),
        ("CERT-IDENTITY-001", certificate_identity),
        ("CERT-CHAIN-001", certificate_chain),
        ("CERT-SELF-SIGNED-001", certificate_self_signed),
        ("STARTTLS-001", starttls),
        ("AUTH-PLAINTEXT-001", auth_plaintext),
        ("TLS-FAILURE-001", tls_failure),
        ("PLAINTEXT-001", plaintext_session),
    ):
        registry.register(rule_id, build)
    return registry


AUTH_SLICE = 4096


def auth_summary(events: DataFrame) -> DataFrame:
    """Per session: the authentication commands in event order, and their packet range.

    The text is built in two levels (slices of consecutive events, then the
    slices), so that one session with very many commands is aggregated by many
    tasks before its single text is put together.
    """
    command = F.coalesce(
        F.nullif(F.try_element_at("detail", F.lit("command")), F.lit("")),
        F.nullif(F.try_element_at("detail", F.lit("mechanism")), F.lit("")),
        F.lit("AUTH"),
    )
    in_order = lambda items: F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), ", ")
    auth = events.where(F.col("type") == "authentication").select(
        "session_id", "seq", command.alias("command"),
        F.array_min("packet_numbers").alias("lo"), F.array_max("packet_numbers").alias("hi"),
        F.call_function("div", F.col("seq"), F.lit(AUTH_SLICE)).alias("slice"),
    )
    sliced = auth.groupBy("session_id", "slice").agg(
        in_order(F.collect_list(F.struct("seq", F.col("command").alias("text")))).alias("part"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return sliced.groupBy("session_id").agg(
        in_order(F.collect_list(F.struct("slice", F.col("part").alias("text")))).alias("auth_commands"),
        F.min("lo").alias("auth_first_packet"), F.max("hi").alias("auth_last_packet"),
    )


def _hit_columns(registry: RuleRegistry, policy: Policy) -> Column:
    """The array of non-NULL findings of a session."""

    def build() -> Column:
        hits = F.array_compact(F.array(*registry.columns(policy)))
        titles = {f"{t[0]}/{t[1]}": t[2] for t in registry.texts()}
        return F.transform(
            hits,
            lambda f: f.withField(
                "finding_id", ids.finding_id(f["rule_id"], F.col("session_id"), f["observed_value"], f["extra"])
            ).withField("title", case_map(F.concat_ws("/", f["rule_id"], f["variant"]), titles)),
        )

    return memo((tuple(registry.rules()), policy), build)


def session_hits(
    sessions: DataFrame, events: DataFrame | None = None, policy: Policy = Policy(),
    registry: RuleRegistry | None = None,
) -> DataFrame:
    """One row per session with the array of its findings (``hits``, possibly empty).

    A rule yields at most one finding per session, so the array is bounded by
    the number of rules. Posture works on this nested form without a shuffle.
    """
    registry = registry or default_registry()
    if "auth_commands" in sessions.columns:  # carried in the session row, as on a stream
        base = sessions
    elif events is not None and "AUTH-PLAINTEXT-001" in registry.rule_ids():
        base = sessions.join(auth_summary(events), "session_id", "left")
    else:
        base = sessions.selectExpr(
            "*", "CAST(NULL AS string) AS auth_commands", "CAST(NULL AS int) AS auth_first_packet",
            "CAST(NULL AS int) AS auth_last_packet",
        )
    return base.withColumn("leaf", leaf()).select(
        "capture_id", "session_id", "protocol", "server_ip", "server_port",
        F.coalesce("ended_at", "started_at").alias("detected_at"),
        _hit_columns(registry, policy).alias("hits"),
    )


DEFAULT_CATEGORY = "configuration"


def evaluate(
    sessions: DataFrame, events: DataFrame | None = None, policy: Policy = Policy(),
    registry: RuleRegistry | None = None,
) -> DataFrame:
    """Findings of every registered rule over many captures at once.

    With unique session ids the deterministic finding ids are unique, so no
    deduplicating shuffle runs.
    """
    registry = registry or default_registry()
    return findings_of(session_hits(sessions, events, policy, registry), policy, registry)


def findings_of(hits: DataFrame, policy: Policy = Policy(), registry: RuleRegistry | None = None) -> DataFrame:
    """The findings table from the nested form of ``session_hits``, which may be stored: rules are not run again."""
    registry = registry or default_registry()
    rows = hits.select("*", F.explode("hits").alias("f")).select(
        "capture_id", "session_id", "protocol", "server_ip", "server_port", "detected_at", "f.*"
    )
    texts = literal_table(
        hits.sparkSession, [t[:2] + t[3:] for t in registry.texts()],
        ["rule_id", "variant", "category", "expected", "action", "target", "rationale", "priority", "standard_name",
         "standard_url"],
    )
    filled = lambda name: F.replace(
        F.replace(F.col(name), F.lit("{min}"), F.lit(policy.tls.minimum_version)), F.lit("{observed}"),
        F.col("observed_value"),
    )
    packets = F.flatten(F.transform("evidence_refs", lambda r: r["packet_numbers"]))
    remediation = F.when(
        F.col("action").isNotNull(), F.struct(filled("action").alias("action"), "target", "rationale", "priority")
    )
    standard = F.when(
        F.col("standard_name").isNotNull(),
        F.struct(F.col("standard_name").alias("name"), F.col("standard_url").alias("url")),
    )
    # a rule registered without texts keeps its findings: default category, nothing expected, no remediation
    return rows.join(F.broadcast(texts), ["rule_id", "variant"], "left").select(
        "finding_id", "capture_id", "session_id", "protocol", "server_ip", "server_port", "rule_id", "title",
        F.concat_ws(": ", "title", "detail").alias("description"),
        "severity", "confidence", F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"), "observed_value",
        F.coalesce("own_expected", filled("expected")).alias("expected_value"),
        remediation.alias("remediation"), standard.alias("standard_reference"), "evidence_refs",
        F.array_min(packets).alias("first_packet"), F.array_max(packets).alias("last_packet"),
        "detected_at",
    )


def nest(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """The nested form from a stored findings table: one shuffle by session."""
    hits = findings.groupBy("session_id").agg(
        F.collect_list(
            F.struct("rule_id", "severity", "confidence", "observed_value", "evidence_refs", "finding_id", "title")
        ).alias("hits")
    )
    keys = sessions.select("capture_id", "session_id", "protocol", "server_ip", "server_port", F.coalesce("ended_at", "started_at").alias("detected_at"))
    return keys.join(hits, "session_id", "left").withColumn("hits", F.coalesce("hits", F.array()))


def deduplicate_findings(findings: DataFrame) -> DataFrame:
    """One row per finding id, for inputs whose session rows are not unique."""
    return findings.dropDuplicates(["finding_id"])
