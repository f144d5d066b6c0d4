"""Members of the shared keys are made once for all that a correlation query reads."""

from datetime import datetime

from pyspark.sql import functions as F

from postern.operators import correlation as C
from postern.plans.registry import QUERIES
from postern.plans.workspace import Workspace

ENTRY = "case_id string, correlation_type string, evidence_key string, strength string, evidence string, capture_id string, session_id string, finding_id string, anomaly_id string, observed_at timestamp, idx bigint"


def entries(spark):
    at = datetime(2024, 1, 1)
    rows = []
    for k in range(12):
        rows.append(("case_1", "shared_host", "host|10.0.0.9", "direct", '[{"k":"ip","v":"10.0.0.9"}]', f"c{k % 3}", f"s{k}", "", "", at, k % 3))
        rows.append(("case_1", "shared_finding", "finding-rule|x", "direct", '[{"k":"rule_id","v":"X"}]', f"c{k % 2}", f"s{k}", f"f{k}", "", None, k % 2))
        rows.append(("case_1", "shared_finding", "finding-rule|x", "direct", '[{"k":"rule_id","v":"X"}]', f"c{k % 2}", f"s{k}", f"g{k}", "", at, k % 2))
    rows += rows[:3] + [("case_1", "shared_host", "host|alone", "direct", "[]", "c1", "s1", "", "", at, 1), (None, "shared_host", "host|10.0.0.9", "direct", "[]", "c1", "s1", "", "", at, 1), (None, "shared_host", "host|10.0.0.9", "direct", "[]", "c2", "s1", "", "", at, 1)]
    return spark.createDataFrame(rows, ENTRY)


def rows(df):
    return sorted(map(str, df.collect()))


def test_members_are_made_once(spark, tmp_path, monkeypatch):
    e, attached = entries(spark), spark.createDataFrame([("case_1", f"c{k}", k) for k in range(3)], "case_id string, capture_id string, idx bigint")
    whole = C.correlate(e)
    inside = C.members(e, whole)
    nodes = C.evidence_nodes(inside, C.merge_evidence(C._grouped(e)), whole)
    expected = {
        "correlation_related_sessions": rows(C.related_sessions(inside, whole)), "correlation_graph_nodes": rows(nodes),
        "case_investigation_graph": rows(C.investigation_graph(attached, whole, inside, nodes)),
    }
    monkeypatch.setattr(Workspace, "index_entries", property(lambda w: e))
    monkeypatch.setattr(Workspace, "case_captures", property(lambda w: attached))
    calls, members = [], C.members
    monkeypatch.setattr(C, "members", lambda *a: calls.append(a) or members(*a))
    for name, want in expected.items():
        assert rows(QUERIES[name](spark, str(tmp_path))) == want and len(want) > 3
    assert rows(QUERIES["correlate_case"](spark, str(tmp_path)).select("correlation_id", "session_count")) == rows(whole.select("correlation_id", "session_count"))
    assert len(calls) <= 4  # one a query at most, and none of them for the correlations
    assert whole.where("correlation_type = 'shared_host'").first()["occurrence_count"] == 13
    assert whole.where(F.col("case_id").isNull()).count() == 0


def test_the_graph_shows_an_edge_once(spark):
    e = entries(spark)
    whole = C.correlate(e)
    edges = C.investigation_graph(spark.createDataFrame([], "case_id string, capture_id string"), whole, C.members(e, whole), spark.createDataFrame([], "case_id string, correlation_id string, node_id string"), session_budget=5)
    got = edges.collect()
    assert len(got) == len(set(got)) and sum(r["edge_type"] == "capture_contains_session" for r in got) == 5
    assert sum(r["edge_type"] == "correlation_involves_session" for r in got) == 10
