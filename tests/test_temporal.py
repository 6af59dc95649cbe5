"""Joins and groups by time against plain ones, and merged sketches against exact values."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import sketches, temporal


def seconds(spark, rows, kind):
    return spark.createDataFrame(rows, kind).selectExpr("*", "timestamp_seconds(s) AS t").drop("s")


def drawn(n, seed, span=900):
    """A key with a third of the rows, null keys and times, ties."""
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 2, 3, None]), rng.choice([rng.randrange(span), rng.randrange(span), 77, None]), rng.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("width", [10, 3600])
def test_asof(spark, width):
    left, right = drawn(200, 1), drawn(150, 2)
    a, b = seconds(spark, left, "i long, k long, s long, v string"), seconds(spark, right, "j long, k long, s long, w string")
    got = sorted(((r.i, r.j, r.w) for r in temporal.asof(a, b, "k", "t", "t", ["j", "w"], width).collect()), key=str)
    want = []
    for i, k, s, _ in left:
        best = max(((t, j, w) for j, kk, t, w in right if k is not None and kk == k and s is not None and t is not None and t <= s), default=(None, None, None))
        want.append((i, *best[1:]))
    assert got == sorted(want, key=str)
    assert temporal.asof(a, b.limit(0), "k", "t", "t", ["j"], width).where("j is null").count() == 200 and temporal.asof(a.limit(0), b, "k", "t", "t", ["j"]).count() == 0


def test_intervals(spark):
    left, right = drawn(120, 3), drawn(120, 4)
    a, b = seconds(spark, left, "i long, k long, s long, v string"), seconds(spark, right, "j long, k long, s long, w string")
    for back in (1, 30):
        got = sorted((r.l.i, r.r.j) for r in temporal.within(a, b, "k", "t", "t", back).collect())
        assert got == sorted((i, j) for i, k, s, _ in left for j, kk, t, _ in right if k is not None and k == kk and s is not None and t is not None and 0 <= s - t <= back)


@pytest.mark.parametrize("width", [7, 3600])
def test_interval_sums_without_pairs(spark, width):
    left, right = drawn(120, 6) + drawn(3, 7), drawn(150, 8)
    a, b = seconds(spark, left, "i long, k long, s long, v string"), seconds(spark, right, "j long, k long, s long, w string")
    got = sorted((r.i, r.n, r.j) for r in temporal.counted(a, b, "k", "t", "t", 30, {"n": F.lit(1), "j": F.col("j")}, width).collect())
    near = lambda k, s: [j for j, kk, t, _ in right if k is not None and k == kk and s is not None and t is not None and 0 <= s - t <= 30]
    assert got == sorted((i, len(near(k, s)), sum(near(k, s))) for i, k, s, _ in left)
    assert temporal.counted(a.limit(0), b, "k", "t", "t", 30, {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("width", [7, 3600])
def test_sessions(spark, width):
    rows = drawn(150, 5, 2000)
    df = seconds(spark, rows, "i long, k long, s long, v string")
    got = sorted(map(tuple, temporal.sessions(df, "k", "t", 20, width).collect()))
    want = []
    for k in (1, 2, 3):
        run = []
        for s in sorted(s for _, kk, s, _ in rows if kk == k and s is not None) + [10**9]:
            if run and s - run[-1] >= 20:
                want.append((k, run[0] * 10**6, run[-1] * 10**6, len(run)))
                run = []
            run.append(s)
    assert got == sorted(want)


def test_merged_sketches_keep_their_bounds(spark):
    rows = spark.range(120_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' END AS kind", "timestamp_seconds(id * 60) AS t", "CASE WHEN id % 7 > 0 THEN CAST(hash(id) AS DOUBLE) END AS v", "pmod(hash(id, 1), 9000) AS c")
    stored = sketches.sketched(rows, ["kind"], "t", "v", "c")
    assert stored.count() > 200
    got = sketches.merged(stored, ["kind"], (0.1, 0.5, 0.99)).collect()
    assert sum(r.n for r in got) == 120_000
    for r in got:
        mine = rows.where(rows.kind.eqNullSafe(r.kind))
        values = sorted(x.v for x in mine.select("v").where("v is not null").collect())
        for p in (0.1, 0.5, 0.99):
            assert abs(sum(v <= r[f"p{round(100 * p)}"] for v in values) / len(values) - p) <= sketches.RANK
        exact = mine.select("c").distinct().count()
        assert abs(r.distinct - exact) <= sketches.DISTINCT * exact
    nothing = sketches.merged(sketches.sketched(rows.selectExpr("kind", "t", "CAST(NULL AS DOUBLE) AS v", "CAST(NULL AS INT) AS c"), ["kind"], "t", "v", "c"), ["kind"]).first()
    assert nothing.p50 is None and nothing.distinct == 0
    assert sketches.merged(stored.limit(0), ["kind"]).count() == 0
