"""The language model's start comes from every training document, whole."""

import numpy as np
import pytest

hmm = pytest.importorskip("postern.llm.hmm")


def test_every_training_document_shapes_the_start_whatever_its_length(spark):
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 40, n).astype("<u2") for n in (1, 9000, 300, 20, 12000)]  # two are longer than the sample took
    corpus = type("C", (), {"mass": np.full(hmm.UNKNOWN + 1, 1 / (hmm.UNKNOWN + 1)), "unknown": 0.1})()
    training = lambda parts: spark.createDataFrame([(t.tobytes(),) for t in texts], "symbols binary").repartition(parts)
    start, moves, emissions = hmm.mixture_start(training(3), corpus, 2)
    assert np.allclose(emissions.sum(axis=1), np.bincount(np.concatenate(texts), minlength=hmm.UNKNOWN + 1))
    again = hmm.mixture_start(training(1), corpus, 2)
    assert np.allclose(again[2], emissions) and (start > 0).all() and moves[0, 0] > moves[0, 1]
    none = hmm.mixture_start(training(1).where("FALSE"), corpus, 2)
    assert not none[2].any()
