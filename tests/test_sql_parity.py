"""Registered queries against their SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from oracle.harness import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# One or two of each family here; the harness (python -m oracle.harness) runs all of them.
CHOSEN = (
    "evaluate_all_rules", "posture_snapshot", "posture_factors", "correlate_case", "drift_chain", "finding_lifecycle", "graph_edges", "graph_depth",
    "verify_rule", "session_features", "top_deviations", "session_build", "stream_coverage", "report_tls_summary", "join_reference_integrity", "stream_rules",
    "drift_compare_explicit", "src_case_evidence", "stream_finding_counts_sliding",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    status, mine, theirs, detail = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert status == "ok" and mine > 0, detail


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 25
