"""Neighbours by cells against all pairs; recall of probes at two sizes."""

import numpy as np
import pytest

from tessera.plans import cells, vectors

KIND = "vec_id long, embedding array<float>, label int, d string"


def all_pairs(rows, queries, most, furthest=2.0, kept=lambda d, label, ql: True):
    have = [(i, np.array(v, float), label) for i, v, label, _ in rows if v is not None]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = set()
    for q, v, ql, _ in queries:
        if v is None:
            continue
        near = sorted((round(1 - float(unit(np.float32(v).astype(float)) @ unit(np.float32(x).astype(float))), 6), i) for i, x, label in have if i != q)
        near = [(d, i) for d, i in near if d <= furthest and kept(d, next(label for j, _, label in have if j == i), ql)]
        out |= {(q, i, k) for k, (d, i) in enumerate(near[:most], 1)}
    return out


def clustered(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    rows = [(k, [float(x) for x in middle[k % 6] + rng.normal(size=dims) * 0.2], k % 3, "x") for k in range(n)]
    # a vector that a third of the rows have, zeros, nulls, opposites
    rows += [(1000 + k, [1.0] + [0.0] * (dims - 1), k % 2, "x") for k in range(n // 2)]
    return [*rows, (5000, [0.0] * dims, 1, "x"), (5001, None, 1, "x"), (5002, [-1.0] + [0.0] * (dims - 1), None, "x")]


@pytest.mark.parametrize(("probes", "count"), [(1, None), (1, 9), (3, 2), (50, 40)])
def test_exact_by_bounds(spark, probes, count, monkeypatch):
    monkeypatch.setattr(cells, "PART", 17)  # a hot cell in many parts
    rows = clustered(120, 1)
    df = spark.createDataFrame(rows, KIND)
    got = {(r.q, r.id, r.rn) for r in cells.neighbours(df, df, 5, probes=probes, cells=count).collect()}
    assert got == all_pairs(rows, rows, 5)


def test_exact_with_a_limit_and_a_rule(spark):
    rows = clustered(60, 2)
    df = spark.createDataFrame(rows, KIND)
    rule = lambda d, id_, label, ql: label == ql
    got = {(r.q, r.id, r.rn) for r in cells.neighbours(df, df.where("vec_id % 7 = 0"), 4, 0.4, rule, probes=1).collect()}
    assert got == all_pairs(rows, [r for r in rows if r[0] % 7 == 0], 4, 0.4, lambda d, label, ql: label is not None and label == ql)
    assert cells.neighbours(df.limit(0), df).count() == 0 and cells.neighbours(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_tuned_probes(spark, sf):
    """Every row is indexed; every id divisible by 20 asks."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0")
    want = {(r.q, r.id) for r in vectors.neighbours(rows, queries).collect()}
    assert {(r.q, r.id) for r in cells.neighbours(rows, queries).collect()} == want
    many = round(rows.count() ** 0.5)
    probes = cells.probes_for(rows, cells=many)
    got = {(r.q, r.id) for r in cells.neighbours(rows, queries, probes=probes, exact=False, cells=many).collect()}
    assert probes < many
    assert len(got & want) / len(want) >= 0.9
