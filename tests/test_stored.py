"""Stored tables with several writers, and the delivery loop across crashes."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import stored
from tessera.sources.published import workspace
from tessera.streaming import delivery

KIND = "id long, v string, created_at int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_two_writers_one_is_refused(spark):
    path = workspace(spark, "t")
    table = lambda *r: spark.createDataFrame(list(r), KIND)
    first = stored.created(table((1, "a", 1), (2, "b", 1)), path, "id", 4)
    second = stored.merge(table((2, "B", 2), (3, "c", 2)), path, stored.REPLACED, first)
    with pytest.raises(stored.Conflict):
        stored.merge(table((1, "lost", 9)), path, stored.REPLACED, first)
    assert rows(stored.read(spark, path)) == [(1, "a", 1), (2, "B", 1), (3, "c", 2)] and stored.revision(spark, path) == 1
    # who was refused reads again and comes after
    stored.merge(table((1, "won", 9)), path, stored.REPLACED, second)
    assert rows(stored.read(spark, path)) == [(1, "won", 1), (2, "B", 1), (3, "c", 2)]
    assert rows(stored.read(spark, path, first)) == [(1, "a", 1), (2, "b", 1)]
    with pytest.raises(stored.Conflict):
        stored.created(table((7, "x", 1)), path, "id", 4)


def test_only_touched_parts_are_written(spark):
    path = workspace(spark, "t")
    stored.created(spark.range(200).selectExpr("id", "'x' AS v", "1 AS created_at"), path, "id", 8)
    stored.merge(spark.createDataFrame([(5, None, 2)], KIND), path, stored.REPLACED, 0)
    state = stored._state(spark, path, 1)
    assert len(set(state["rows"].values())) == 2 and sum(w != state["rows"]["0"] for w in state["rows"].values()) in (1, 7)
    got = stored.read(spark, path)
    assert got.count() == 200 and rows(got.where("v is null")) == [(5, None, 1)]
    assert stored.merge(got.limit(0), path, {}, 1) == 1 and stored.revision(spark, path) == 1
    with pytest.raises(ValueError, match="null"):
        stored.merge(spark.createDataFrame([(None, "n", 1)], KIND), path, {}, 1)
    stored.merge(spark.createDataFrame([(5, "gone", 2)], KIND), path, {}, 1, keep="v <> 'gone'")
    assert stored.read(spark, path).count() == 199


def test_changes_may_come_late_and_again(spark):
    path = workspace(spark, "t")
    kind = "id long, seq long, segment string, city string, gone boolean, first_at int, n long"
    stored.created(spark.createDataFrame([(1, 5, None, "c5", False, 5, 1)], kind), path, "id")
    stored.merge(spark.createDataFrame([(1, 3, "s3", "c3", True, 3, 1), (2, 1, "s1", None, None, 1, 1)], kind), path, stored.CHANGES, 0)
    stored.merge(spark.createDataFrame([(1, 7, "s7", None, False, 7, 2), (2, 0, "s0", "c0", False, 0, 1)], kind), path, stored.CHANGES, 1)
    assert rows(stored.read(spark, path)) == [(1, 7, "s7", "c5", False, 3, 4), (2, 1, "s1", "c0", None, 0, 2)]


def test_a_crash_between_claim_and_delivery(spark):
    sent = []

    def deliver(claims, number):
        sent.append(number)
        if sent == [0, 1]:
            raise RuntimeError("the driver is lost")
        up = F.col("id") % 10 <= number
        return claims.withColumn("outcome", F.when(F.col("id") % 7 == 0, "blocked").when(up, "sent").otherwise("retry"))

    box = delivery.Outbox(spark, "id", deliver)
    come = workspace(spark, "come")
    stream = lambda: spark.readStream.schema("id long, what string").parquet(f"{come}/part=*")
    for k in range(3):
        # each part repeats a row of the one before
        spark.createDataFrame([(i, "x") for i in range(20 * k - (k > 0), 20 * k + 20)] + [(20 * k + 1, "x"), (None, "x")], "id long, what string").write.parquet(f"{come}/part={k}")
        if k == 1:
            with pytest.raises(Exception, match="lost"):
                box.run(stream())
            assert spark.read.parquet(f"{box.root}/claims/round=1").count() and box.outcomes(1) is None
        box.run(stream())
    assert sent == [0, 1, 1, 2] and box.drain(3) == 5
    got = {r.id: (r.status, r.attempt, r["round"]) for r in box.table().collect()}
    assert box.table().count() == len(got) == 60
    for i in range(60):
        batch = i // 20
        tries = max(1, i % 10 - batch + 1)
        assert got[i] == (("blocked", 1, batch) if i % 7 == 0 else ("dead", 3, batch + 2) if tries > 3 else ("sent", tries, batch + tries - 1)), i
