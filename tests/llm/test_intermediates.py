"""What the corpus pipeline leaves on disk."""

import os

import corpus_pipeline
from postern.llm import ngram_join
from postern.llm.common import bucketed, intermediates, kept, new_folder, written


def folders(spark) -> set[str]:
    return set(os.listdir(os.path.dirname(new_folder(spark, "x"))))


def test_a_stage_leaves_its_result_only(spark, monkeypatch):
    def stage(spark, docs, sf_dir):
        halves = bucketed(docs, "doc_id", 2, "halves")
        return written(halves.groupBy("doc_id").count(), "counts").join(docs, "doc_id").drop("count")

    docs = spark.createDataFrame([(k, "a b") for k in range(20)], "doc_id bigint, text string")
    written(docs, "documents")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    before, tables = folders(spark), len(spark.catalog.listTables())
    out = corpus_pipeline.run(spark, "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))
    assert sorted(f.split("-")[0] for f in folders(spark) - before) == ["one", "two"]
    assert len(spark.catalog.listTables()) == tables


def test_tables_made_outside_a_stage_stay(spark):
    rows = spark.range(5)
    kept = written(rows, "kept")
    with intermediates(spark):
        written(rows, "gone")
    assert kept.count() == 5 and written(rows, "later").count() == 5


def test_written_tables_leave_no_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    written(spark.range(5).repartition(3), "rows")
    assert spark.conf.get(key, None) == before


def test_stages_called_alone_leave_one_table(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen " * 3
    docs = written(spark.createDataFrame([(k, text if k % 2 else f"{text} {k} {k} {k} {k}", k) for k in range(12)], "doc_id bigint, text string, n_chars bigint"), "documents")
    before, tables = folders(spark), len(spark.catalog.listTables())
    one = ngram_join.one_of_each_group(docs)
    assert sorted(f.split("-")[0] for f in folders(spark) - before) == ["gone"] and one.count() < 12
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert sorted(f.split("-")[0] for f in folders(spark) - before) == ["gone", "without"]
    assert cut.count() == 12 and len(spark.catalog.listTables()) == tables


def test_a_kept_table_belongs_to_the_caller(spark):
    before = folders(spark)
    with intermediates(spark):
        assert kept(spark, lambda: written(spark.range(3), "step"), "result").count() == 3
        assert sorted(f.split("-")[0] for f in folders(spark) - before) == ["result"]
    assert folders(spark) == before
