"""The cluster's fit against a plain one, row by row."""

import numpy as np
import pytest

from tessera.functions import fit


def plain(x, y, allowed, penalty, steps=60_000, rate=0.5):
    """Projected gradient steps, as many as it takes."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        new = np.maximum(0, w - rate * (x.T @ e + penalty * w)) * allowed
        moved, b = np.abs(new - w).max() + abs(e.sum()), b - rate * e.sum()
        w = new
        if moved < 1e-12:
            break
    return w, b


@pytest.mark.parametrize(("n", "penalty"), [(3000, 0.05), (400, 0.001)])
def test_weights_and_ablations(spark, n, penalty):
    rng = np.random.default_rng(3)
    names = fit.SIGNALS
    x = (rng.random((n, len(names))) < rng.uniform(0, 0.4, len(names))).astype(float)
    x[:, 5] = 0  # never fires
    truth = rng.normal(0.4, 1, len(names))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ truth - 2)))).astype(float)
    masks = (x.astype(np.int64) << np.arange(len(names))).sum(axis=1)
    rows = spark.createDataFrame([(int(m), int(v)) for m, v in zip(masks, y, strict=True)], "mask long, y long").groupBy("mask", "y").count().toDF("mask", "y", "n").repartition(3)
    assert rows.count() > n // 2
    for model, (weights, bias, off) in fit.fitted(rows, names, fit.MODELS, penalty).items():
        allowed = np.array([s not in fit.MODELS[model] for s in names], float)
        w, b = plain(x, y, allowed, penalty)
        assert np.abs(np.array(list(weights.values())) - w).max() < 1e-6 and abs(bias - b) < 1e-6 and off <= fit.CLOSE
        assert weights[names[5]] == 0 and min(weights.values()) == 0


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "mask long, y long, n long")
    assert fit.fitted(empty, ["a"], {"none": ()}) == {"none": ({"a": 0.0}, 0.0, 0.0)}
    assert fit.fitted(spark.createDataFrame([(1, 1, 9)], empty.schema), ["a"], {"none": ()})["none"][0] == {"a": 0.0}
