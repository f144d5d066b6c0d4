"""Tiles of blocks of vectors: every pair of blocks once, and no block is shuffled for its tiles."""

import numpy as np

from postern.llm import embedding_dedup


def test_tiles_read_blocks_where_they_are(spark, monkeypatch):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((700, 6))
    v[300:420] = v[299] + 0.2 * draw.standard_normal((120, 6))
    v[500:530] = v[499]
    v = v.astype(np.float32).astype(float)
    plans, write = {}, embedding_dedup.written
    monkeypatch.setattr(embedding_dedup, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    for kind in ("float", "double"):
        table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], f"vec_id bigint, embedding array<{kind}>")
        result = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, 0.9).collect()}
        assert [result[k].n_links for k in range(700)] == close.sum(axis=1).tolist() and close.sum() > 5000
        for k in range(700):
            assert result[k].component_id == min(result[j].component_id for j in [k, *np.flatnonzero(close[k])])
    assert "Exchange" not in plans["tile-links"] and "CartesianProduct" in plans["tile-links"]
