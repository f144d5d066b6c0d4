"""The versioned store: one switch, pruned scans, lost writers, clean-up."""

import pytest
from pyspark.sql import functions as F

from postern.sources import tables

SCHEMA = "finding_id string, n int, capture_id string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, n, c) for n, (i, c) in enumerate(rows)], SCHEMA)


def files_read(plan):
    """Files that the scan of the stored rows opened, by its metric."""
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec" and "finding_id" in plan.simpleString(5):
        return plan.metrics().get("numFiles").get().value()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    return sum(files_read(p) for p in [*inner, *[children.apply(i) for i in range(children.size())]])


def stored(spark, path, captures=None, table=tables.ROWS):
    return {(r.finding_id, r.capture_id) for r in tables.scan(spark, path, captures, table).collect()}


def test_a_writer_lost_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    first = {"findings": frame(spark, ("f1", "a"), ("f2", "b"), ("f3", "c")), "posture": frame(spark, ("p1", "a"), ("p2", "b"))}
    assert tables.replace_tables(first, path) == 1
    before = (stored(spark, path, table="findings"), stored(spark, path, table="posture"))

    def lost(*_):
        raise RuntimeError("lost")

    second = {"findings": frame(spark, ("f4", "a")), "posture": frame(spark, ("p4", "a"))}
    both = spark.createDataFrame([("a",), ("b",)], "capture_id string")
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            tables.replace_tables(second, path, both)
    assert (stored(spark, path, table="findings"), stored(spark, path, table="posture")) == before
    assert tables.replace_tables(second, path, both) == 2
    assert stored(spark, path, table="findings") == {("f4", "a"), ("f3", "c")}
    assert stored(spark, path, table="posture") == {("p4", "a")}


def test_versions_are_not_taken_twice_and_the_last_stands(spark, tmp_path):
    path = f"{tmp_path}/store"
    for n in range(3):
        tables.replace_captures(frame(spark, (f"f{n}", "a"), ("same", f"only{n}")), path)
    assert stored(spark, path) == {("f2", "a"), ("same", "only0"), ("same", "only1"), ("same", "only2")}
    taken = tables._commit(spark, path, "elsewhere", {})
    assert taken == 4 and tables._commit(spark, path, "elsewhere", {}) == 5
    assert tables.vacuum(spark, path) == 2 and tables.vacuum(spark, path) == 0
    assert stored(spark, path) == {("f2", "a"), ("same", "only0"), ("same", "only1"), ("same", "only2")}


def test_scans_of_some_captures_open_their_folders_only(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.range(4000).select(F.col("id").cast("string").alias("finding_id"), F.col("id").cast("int").alias("n"), F.concat(F.lit("0"), F.col("id") % 40).alias("capture_id"))
    tables.replace_captures(rows, path)
    tables.replace_captures(rows.where("capture_id = '07'").limit(3), path)
    wanted = spark.createDataFrame([("case", "07"), ("case", "011"), ("other", "05")], "case_id string, capture_id string").where("case_id = 'case'")
    some = tables.scan(spark, path, wanted)
    assert some.groupBy("capture_id").count().count() == 2 and some.count() == 103
    some.collect()
    assert files_read(some._jdf.queryExecution().executedPlan()) == 2
    everything = tables.scan(spark, path)
    everything.collect()
    assert files_read(everything._jdf.queryExecution().executedPlan()) >= 40
    assert tables.scan(spark, path, ["07"]).count() == 3
    assert tables.scan(spark, path).schema.simpleString() == rows.schema.simpleString()


def test_empty_tables_new_columns_and_rows_without_a_capture(spark, tmp_path):
    path = f"{tmp_path}/store"
    tables.replace_captures(spark.createDataFrame([], SCHEMA), path)
    assert stored(spark, path) == set()
    tables.replace_captures(frame(spark, ("f1", "a")), path)
    tables.replace_captures(spark.createDataFrame([("f2", "b", True)], "finding_id string, capture_id string, seen boolean"), path)
    assert {tuple(r) for r in tables.scan(spark, path).select("finding_id", "capture_id", "seen").collect()} == {("f1", "a", None), ("f2", "b", True)}
    with pytest.raises(Exception, match="row without capture_id"):
        tables.replace_captures(frame(spark, ("f9", None)), path)
    assert tables.scan(spark, path).count() == 2
    with pytest.raises(ValueError, match="no committed table other"):
        tables.scan(spark, path, table="other")
