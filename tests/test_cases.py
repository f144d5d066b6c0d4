"""Golden sessions, lifecycle matrix, policies and identifiers on small inline rows."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postern.functions import fixed_values as V
from postern.functions import labels
from postern.functions import normalize as N
from postern.functions.columns import half_even
from postern.operators import anomaly as A
from postern.operators import correlation as CO
from postern.operators import drift as D
from postern.operators import graph as G
from postern.operators import posture, rules
from postern.sources.policy import Policy, load_policy
from postern.sources.testdata import Evidence

HANDSHAKE = (
    "struct<handshake_id:string,tls_version:string,cipher_suite_code:int,cipher_suite:string,key_exchange:string,cipher_suites_offered:array<string>,"
    "sni_server_name:string,handshake_complete:boolean,completeness_reason:string,client_hello_packets:array<int>,server_hello_packets:array<int>>"
)
CERT = (
    "struct<position_in_chain:int,certificate_id:string,subject:string,issuer:string,not_before:timestamp,not_after:timestamp,signature_algorithm:string,"
    "public_key_algorithm:string,public_key_size_bits:int,subject_alternative_names:array<string>,fingerprint_sha256:string>"
)
SESSION = (
    "session_id string, capture_id string, protocol string, server_ip string, server_port int, implicit_tls boolean, started_at timestamp, ended_at timestamp, "
    f"starttls struct<advertised:boolean,requested:boolean,response_seen:boolean,packet_number:int>, handshake {HANDSHAKE}, certificates array<{CERT}>"
)
ECDHE_GCM = (49199, "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "ecdhe")


def certificate(subject="CN=mail.example.org", issuer="CN=CA", position=0, bits=2048, signature="sha256WithRSAEncryption", sans=("mail.example.org",), until="2030-01-01"):
    import datetime as dt

    day = lambda s: dt.datetime.fromisoformat(s)
    return (position, "c", subject, issuer, day("2020-01-01"), day(until), signature, "RSA", bits, list(sans), "ab" * 32)


CHAIN = [certificate(), certificate("CN=CA", "CN=Root", 1)]


def session(name, version=None, suite=ECDHE_GCM, certs=(), starttls=None, complete=True):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    hs = version and ("t", version, suite[0], suite[1], suite[2], [], "mail.example.org", complete, None, [4], [6])
    return (name, "capture_" + name, "smtp", "10.0.0.1", 25, False, at, at, starttls, hs or None, list(certs))


UPGRADED = (True, True, True, 3)
GOLDEN = {
    "secure12": (session("secure12", "TLS 1.2", certs=CHAIN, starttls=UPGRADED), set(), "healthy"),
    "tls10": (session("tls10", "TLS 1.0", (49171, "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", "ecdhe"), [certificate()], UPGRADED), {"TLS-VERSION-001", "CIPHER-SELECTED-001", "CERT-CHAIN-001"}, "degraded"),
    "tripledes": (session("tripledes", "TLS 1.2", (10, "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "rsa"), CHAIN, UPGRADED), {"CIPHER-SELECTED-001", "KEYEX-001"}, "acceptable"),
    "expired": (session("expired", "TLS 1.2", certs=[certificate(until="2021-01-01")], starttls=UPGRADED), {"CERT-VALIDITY-001", "CERT-CHAIN-001"}, "acceptable"),
    "sha1": (session("sha1", "TLS 1.2", certs=[certificate(signature="sha1WithRSAEncryption")], starttls=UPGRADED), {"CERT-SIG-001", "CERT-CHAIN-001"}, "acceptable"),
    "weakkey": (session("weakkey", "TLS 1.2", certs=[certificate(bits=1024)], starttls=UPGRADED), {"CERT-KEY-001", "CERT-CHAIN-001"}, "acceptable"),
    "san": (session("san", "TLS 1.2", certs=[certificate(sans=("other.example.org",))], starttls=UPGRADED), {"CERT-IDENTITY-001", "CERT-CHAIN-001"}, "acceptable"),
    "selfsigned": (session("selfsigned", "TLS 1.2", certs=[certificate(issuer="CN=mail.example.org")], starttls=UPGRADED), {"CERT-SELF-SIGNED-001"}, "healthy"),
    "refused": (session("refused", starttls=(True, True, False, 3)), {"STARTTLS-001", "PLAINTEXT-001"}, "acceptable"),
    "plain": (session("plain"), {"PLAINTEXT-001"}, "acceptable"),
    "incomplete": (session("incomplete", "TLS 1.2", starttls=UPGRADED, complete=False), {"TLS-FAILURE-001"}, "healthy"),
}


def test_golden_rules_and_posture(spark):
    sessions = spark.createDataFrame([g[0] for g in GOLDEN.values()], SESSION)
    found = {}
    for r in rules.evaluate(sessions).select("session_id", "rule_id").collect():
        found.setdefault(r.session_id, set()).add(r.rule_id)
    assert {k: found.get(k, set()) for k in GOLDEN} == {k: g[1] for k, g in GOLDEN.items()}
    score = posture.posture_score(posture.posture_factors(rules.session_hits(sessions)))
    assert {r.capture_id[8:]: r.posture_state for r in score.collect()} == {k: g[2] for k, g in GOLDEN.items()}


def test_policy_document(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"id": "x", "tls": {"minimum_version": "TLS 1.3"}}))
    loaded = load_policy(spark, str(path))
    assert (loaded.id, loaded.tls.minimum_version, loaded.certificates) == ("x", "TLS 1.3", Policy().certificates)
    path.write_text(json.dumps({"tls": {"minimum": "TLS 1.3"}}))
    with pytest.raises(ValueError):
        load_policy(spark, str(path))
    path.write_text("{broken")
    with pytest.raises(ValueError):
        load_policy(spark, str(path))


def test_half_even_is_exact(spark):
    rows = [(n, d) for n in range(0, 60) for d in range(1, 9)]
    out = spark.createDataFrame(rows, "n bigint, d bigint").withColumn("q", half_even(F.col("n"), F.col("d"))).collect()
    from fractions import Fraction

    assert all(r.q == round(Fraction(r.n, r.d)) for r in out)


CASES = [
    # presence per position (p present, a absent), expected lifecycle of the last capture against the first
    ("pp", "persistent"), ("pa", "resolved"), ("ap", "new"), ("pap", "recurred"), ("ppp", "persistent"), ("aap", "new"), ("app", "new"), ("apap", "recurred"), ("paa", "resolved"),
]


def test_lifecycle_matrix(spark):
    chain, sessions, findings = [], [], []
    for trace, _ in CASES:
        for pos, state in enumerate(trace):
            capture = f"{trace}-{pos}"
            chain.append((trace, capture, pos))
            sessions.append((capture, f"s{capture}", "smtp", "10.0.0.1", 25))
            if state == "p":
                findings.append((capture, "R", f"f{capture}", "high", "T", "smtp", "10.0.0.1", 25))
            findings.append((capture, "OTHER", f"o{capture}", "low", "O", "smtp", "10.0.0.1", 25))
    ch = spark.createDataFrame(chain, "case_id string, capture_id string, pos bigint")
    se = spark.createDataFrame(sessions, "capture_id string, session_id string, protocol string, server_ip string, server_port int")
    fi = spark.createDataFrame(findings, "capture_id string, rule_id string, finding_id string, severity string, title string, protocol string, server_ip string, server_port int")
    base = ch.where("pos = 0").selectExpr("case_id", "capture_id AS baseline_capture_id")
    rows = D.finding_lifecycle(ch, D.pairs(ch, base), fi, se).where("rule_id = 'R'").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.later_pos):
        last[r.case_id] = (r.later_pos, r.lifecycle)
    assert {t: last[t][1] for t, _ in CASES} == dict(CASES)


def test_posture_and_protocol_drift(spark):
    chain = spark.createDataFrame([("c", "a", 0), ("c", "b", 1), ("c", "d", 2)], "case_id string, capture_id string, pos bigint")
    none = spark.createDataFrame([], "case_id string, baseline_capture_id string")
    pairs = D.pairs(chain, none)
    posture_ = spark.createDataFrame([("a", "healthy", 95), ("b", "degraded", 70), ("d", "degraded", 70)], "capture_id string, posture_state string, overall_score bigint")
    records = D.drift_posture(pairs, posture_).collect()
    assert [(r.before_value, r.after_value) for r in records] == [("healthy:95", "degraded:70")]
    sessions = spark.createDataFrame([("a", "smtp"), ("b", "smtp"), ("b", "imap"), ("d", "imap")], "capture_id string, protocol string")
    changed = {(r.evidence_key, r.comparison_capture_id, r.after_value) for r in D.drift_protocol(chain, pairs, sessions).collect()}
    assert changed == {("protocol|imap", "b", "present"), ("protocol|smtp", "d", "absent")}


def test_member_digest_splits_large_keys(spark):
    rows = [("c", "t", "k", f"cap{i % 3}", f"s{i:03d}", "", "", 90) for i in range(90)]
    members = spark.createDataFrame(rows, "case_id string, correlation_type string, evidence_key string, capture_id string, session_id string, finding_id string, anomaly_id string, occurrence_count bigint")
    import hashlib

    whole = CO.member_digest(members).first().correlation_id
    text = "c|t|k|" + "|".join(sorted(f"cap{i % 3}|s{i:03d}" for i in range(90)))
    assert whole == "corr_" + hashlib.sha256(text.encode()).hexdigest()[:16]
    split = CO.member_digest(members, leaf=16).first().correlation_id
    assert split != whole and split == CO.member_digest(members.repartition(7), leaf=16).first().correlation_id


def test_graph_depth_handles_cycles_and_islands(spark):
    nodes = spark.createDataFrame([("x", n, "capture" if n == "r" else "n") for n in "rabcz"], "capture_id string, node_id string, node_type string")
    edges = spark.createDataFrame([("x", a, b) for a, b in ("ra", "ab", "ba", "bc", "zc")], "capture_id string, source_node_id string, target_node_id string")
    assert {r.node_id: r.depth for r in G.graph_depth(nodes, edges).collect()} == {"r": 0, "a": 1, "b": 2, "c": 3, "z": 4}


def test_normalizers(spark):
    df = spark.createDataFrame([(" 2001:DB8:0:0::1 ",), ("010.1.1.1",), ("1.2.3.4",), ("x",), (None,)], "v string")
    assert [r.o for r in df.select(N.normalize_ip("v").alias("o")).collect()] == ["2001:db8::1", None, "1.2.3.4", None, None]
    one = spark.range(1).select(
        N.normalize_hostname(F.lit(" Mail.Example.org. ")).alias("h"), N.normalize_hostname(F.lit("a b")).alias("bad"), N.redact_line(F.lit("auth plain xyz")).alias("r"),
        labels.safe_number(F.lit(float("nan"))).alias("nan"), labels.safe_number(F.lit(1e15)).alias("big"),
    ).first()
    assert tuple(one) == ("mail.example.org", None, "AUTH redacted", 0.0, 1e12)


def test_same_results_under_other_partitioning(spark):
    e = Evidence(spark, "/root/testdata/sf0.001")
    digest = lambda df: df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    first = digest(rules.evaluate(e.sessions, e.session_events).drop("evidence_refs"))
    second = digest(rules.evaluate(e.sessions.repartition(13), e.session_events.repartition(3)).drop("evidence_refs"))
    assert first == second


def test_findings_of_a_rule_without_texts_are_kept(spark):
    sessions = spark.createDataFrame([GOLDEN["plain"][0]], SESSION)
    registry = rules.RuleRegistry().register("OWN-001", lambda policy: rules.finding("OWN-001", "own", "info", "high", "none", F.array(rules._ref("SessionEvents", rules._none(), F.lit("seen")))))
    rows = rules.evaluate(sessions, registry=registry).collect()
    assert [(r.rule_id, r.category, r.remediation) for r in rows] == [("OWN-001", rules.DEFAULT_CATEGORY, None)]


def test_replace_empties_captures_without_rows(spark, tmp_path):
    from postern.sources import tables

    schema = "finding_id string, capture_id string"
    path = f"{tmp_path}/findings"
    tables.replace_captures(spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f3", "c")], schema), path)
    again = spark.createDataFrame([("f4", "a")], schema)
    tables.replace_captures(again, path, spark.createDataFrame([("a",), ("b",)], "capture_id string"))
    assert {(r.finding_id, r.capture_id) for r in tables.scan(spark, path).collect()} == {("f4", "a"), ("f3", "c")}


def test_replace_empties_captures_with_awkward_names(spark, tmp_path):
    from postern.sources import tables

    schema = "finding_id string, capture_id string"
    path = f"{tmp_path}/findings"
    tables.replace_captures(spark.createDataFrame([("f1", "a:1"), ("f2", "b/../c"), ("f3", "c"), ("f4", "50%=x")], schema), path)
    gone = spark.createDataFrame([("a:1",), ("b/../c",), ("50%=x",)], "capture_id string")
    tables.replace_captures(spark.createDataFrame([("f5", "50%=x")], schema), path, gone)
    assert {(r.finding_id, r.capture_id) for r in tables.scan(spark, path).collect()} == {("f3", "c"), ("f5", "50%=x")}


def test_lifecycle_keeps_anchors_apart(spark):
    names, states = ["a", "b", "c", "d"], "paap"
    ch = spark.createDataFrame([("k", n, p) for p, n in enumerate(names)], "case_id string, capture_id string, pos bigint")
    se = spark.createDataFrame([(n, f"s{n}", "smtp", "10.0.0.1", 25) for n in names], "capture_id string, session_id string, protocol string, server_ip string, server_port int")
    found = [(n, "R", f"f{n}", "high", "T", "smtp", "10.0.0.1", 25) for n, s in zip(names, states, strict=True) if s == "p"] + [(n, "OTHER", f"o{n}", "low", "O", "smtp", "10.0.0.1", 25) for n in names]
    fi = spark.createDataFrame(found, "capture_id string, rule_id string, finding_id string, severity string, title string, protocol string, server_ip string, server_port int")
    pairs = lambda *anchors: spark.createDataFrame([("k", "c", "d", 3, n, p) for n, p in anchors], "case_id string, previous_capture_id string, later_capture_id string, later_pos bigint, anchor_capture_id string, anchor_pos bigint")
    lifecycle = lambda p: {r.anchor_capture_id: r.lifecycle for r in D.finding_lifecycle(ch, p, fi, se).where("rule_id = 'R'").collect()}
    alone = lifecycle(pairs(("b", 1)))
    assert lifecycle(pairs(("a", 0), ("b", 1)))["b"] == alone["b"] == "new"


def test_requested_pairs_resolve_or_say_why_not(spark):
    attached = spark.createDataFrame([("k", n, i) for i, n in enumerate("abcd")] + [("other", "z", 0)], "case_id string, capture_id string, idx bigint")
    analysis = spark.createDataFrame([(n, "pending" if n == "c" else "completed") for n in "abcdz"], "capture_id string, status string")
    stored = spark.createDataFrame([("k", "b")], "case_id string, baseline_capture_id string")
    asked = [
        ("k", "a", "d", None), ("k", " ", "d", None), ("k", "d", "a", None), ("k", "a", "d", "a"), ("k", "a", "b", "d"), ("k", "a", "a", None), ("k", "a", "c", None),
        ("k", "z", "d", None), ("k", "a", "d", "z"), ("k", "a", "d", "c"), ("k", "d", "b", "c"), ("other", None, "z", None), ("k", "a", "d", None), ("k", "a", None, None),
    ]
    requests = spark.createDataFrame(asked, "case_id string, baseline_capture_id string, comparison_capture_id string, anchor_capture_id string")
    rows = D.requested_pairs(requests, attached, D.chain(attached, analysis), stored).collect()
    good = {(r.previous_capture_id, r.later_capture_id, r.anchor_capture_id, r.anchor_pos, r.later_pos) for r in rows if r.problem is None}
    # b anchors what follows it; an anchor after the comparison, also one not analysed, gives way to the pair's baseline
    assert good == {("a", "d", "b", 1, 2), ("b", "d", "b", 1, 2), ("d", "a", "d", 2, 0), ("a", "d", "a", 0, 2), ("a", "b", "a", 0, 1), ("d", "b", "d", 2, 1)}
    assert sorted(r.problem for r in rows if r.problem) == sorted([
        "captures are the same", "comparison capture has not been analysed", "baseline capture is not in the case", "anchor capture is not in the case",
        "anchor capture has not been analysed", "no baseline selected", "comparison capture is not in the case",
    ])


def test_changes_of_any_pair(spark):
    presence = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "y", "other"), ("b", "z", "3")], "capture_id string, entity string, detail string")
    pairs = spark.createDataFrame([("k", "a", "b", 1, "a", 0), ("k", "b", "a", 0, "b", 1), ("k", "a", "none", 2, "a", 0)], "case_id string, previous_capture_id string, later_capture_id string, later_pos bigint, anchor_capture_id string, anchor_pos bigint")
    rows = {(r.previous_capture_id, r.later_capture_id, r.entity, r.detail, r.in_later) for r in D.pair_changes(presence, None, pairs, ["entity"]).collect()}
    assert rows == {("a", "b", "x", "1", False), ("a", "b", "z", "3", True), ("b", "a", "x", "1", True), ("b", "a", "z", "3", False), ("a", "none", "x", "1", False), ("a", "none", "y", "2", False)}


def test_every_session_can_shape_a_tree(spark):
    """Only sessions outside one hash-ordered pool of 1,024 differ, yet trees tell them apart."""
    rank = F.row_number().over(Window.orderBy(F.xxhash64("session_id", F.lit(V.FOREST_SEED)), "session_id"))
    sessions = spark.range(8000).select(F.concat(F.lit("s"), "id").alias("session_id")).withColumn("outside", (rank > 1024).cast("int"))
    names = [A._column(n) for n in V.FEATURE_NAMES]
    features = sessions.select(
        F.lit("c").alias("capture_id"), "session_id", F.lit("smtp").alias("protocol_group"), *[(F.col("outside") if n == "packet_count" else F.lit(0)).cast("double").alias(n) for n in names]
    )
    forests = A.train_forests(features).collect()
    assert sum(len(r.starts) for r in forests) == V.FOREST_TREES and {r.psi for r in forests} == {V.FOREST_SAMPLE}
    assert all(r.feature[start] >= 0 for r in forests for start in r.starts)
    drawn = A.forest_sample(features).groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("d")).collect()
    assert {(r.n, r.d) for r in drawn} == {(V.FOREST_SAMPLE * A.TREE_BLOCK,) * 2}
