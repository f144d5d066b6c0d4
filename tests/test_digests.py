"""The digest tree against a plain recursion and its SQL, at depths 0 to 2."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from oracle.digests import tree_sql
from postern.operators import reports
from postern.operators.digests import FAN_OUT, tree_text


def plain(items, leaf, separator="|"):
    place = {i: hashlib.md5(i.encode()).hexdigest() for i in items}
    depth = 0
    while len(items) > leaf * FAN_OUT**depth:
        depth += 1

    def node(members, level):
        if level == depth:
            return separator.join(sorted(members))
        parts = {}
        for m in members:
            parts.setdefault(place[m][: 2 * level + 2], []).append(m)
        return separator.join(hashlib.sha256(node(parts[k], level + 1).encode()).hexdigest() for k in sorted(parts))

    return depth, node(items, 0)


def test_tree_text_at_every_depth(spark):
    groups = {"one": ["a"], "leaf": [f"i{k}" for k in range(2)], "wide": [f"i{k}" for k in range(400)], "deep": [f"é{k}" for k in range(1500)], "": ["", "|"]}
    rows = [(g, item, len(items)) for g, items in groups.items() for item in items]
    table = spark.createDataFrame(rows, "g string, item string, n bigint").repartition(5)
    got = {r.g: r.text for r in tree_text(table, ["g"], 2).collect()}
    assert [plain(groups[g], 2)[0] for g in ("one", "leaf", "wide", "deep")] == [0, 0, 1, 2]
    assert got == {g: plain(items, 2)[1] for g, items in groups.items()}
    con = duckdb.connect()
    con.register("items", table.toPandas())
    assert dict(con.execute(tree_sql("items", "g", 2)).fetchall()) == got
    assert tree_text(table.limit(0), ["g"], 2).count() == 0


def test_tree_needs_two_exchanges(spark):
    table = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("string").alias("item"), F.lit(143).cast("bigint").alias("n"))
    plan = tree_text(table, ["g"], 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_evidence_digest_counts_copies(spark):
    rows = [("c", f"t{k % 40}") for k in range(100)] + [("d", "x"), ("d", None)]
    table = spark.createDataFrame(rows, "case_id string, text string")
    digest = lambda df, leaf: {r.case_id: r.evidence_digest for r in reports.evidence_digest(df, leaf).collect()}
    copies = {}
    for _, t in rows[:100]:
        copies[t] = copies.get(t, 0) + 1
    items = [f"{hashlib.sha256(t.encode()).hexdigest()}:{n}" for t, n in copies.items()]
    for leaf in (4, 64):
        assert digest(table, leaf)["c"] == hashlib.sha256(plain(items, leaf)[1].encode()).hexdigest()
    assert digest(table, 4) == digest(table.repartition(9), 4)
    assert digest(table, 4)["c"] != digest(table.unionByName(table.limit(1)), 4)["c"] or digest(table, 4)["d"] != digest(table.unionByName(table.limit(1)), 4)["d"]
