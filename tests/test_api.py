"""Operators as functions of DataFrames."""

import time

import pytest
from pyspark.sql import functions as F

from tessera import operators
from tessera.plans import vectors


def test_search_and_pages(spark):
    rows = spark.createDataFrame([(k, f"100% of_{k}" if k % 2 else None, "ab"[k % 3 == 0]) for k in range(50)], "id long, text string, account string")
    assert operators.search(rows, "OF_1").count() == sum(f"of_{k}".startswith("of_1") for k in range(1, 50, 2))
    assert operators.search(rows, "100%", equal={"account": "b"}, over="id", since=10, until=30).count() == sum(k % 2 == 1 and k % 3 == 0 for k in range(10, 30))
    assert operators.search(rows).count() == 50 and operators.search(rows, "").count() == 50
    first, total, more = operators.page(rows, [F.desc("account")], "id", 20, 2)
    assert (first.count(), total, more) == (10, 50, False)
    assert operators.page(rows, [], "id", 20, 9)[0].count() == 0
    with pytest.raises(ValueError):
        operators.page(rows, [], "id", 0)


def test_fusion(spark):
    lexical = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, id long, rank int")
    semantic = spark.createDataFrame([(1, 11, 1, 0.1), (1, 12, 2, 1.5)], "q long, id long, rank int, d double")
    got = [(r.id, r.place) for r in operators.fused(lexical, semantic).orderBy("place").collect()]
    assert got == [(11, 1), (10, 2), (12, 3)]


def test_apply(spark):
    rows = spark.createDataFrame([("a", "x" * 9), ("a", "y"), ("b", "é")], "source string, text string")
    assert sorted(map(tuple, operators.apply("token_estimate", documents=rows).collect())) == [("a", 4), ("b", 1)]
    with pytest.raises(KeyError):
        operators.apply("no_such_query", documents=rows)


def test_calls_are_given_up(spark):
    rows = spark.createDataFrame([(k, k) for k in range(6)], "id long, s long").repartition(1)

    def call(row):
        if row["s"] == 3:
            time.sleep(1.5)
        if row["s"] == 4:
            raise KeyError
        return str(row["s"])

    got = {r.id: (r.status, r.answer) for r in operators.bounded_calls(rows, call, "id", 2, 0.5).collect()}
    assert got == {0: ("ok", "0"), 1: ("ok", "1"), 2: ("ok", "2"), 3: ("timeout", None), 4: ("failed", "KeyError"), 5: ("ok", "5")}


def test_steps_are_bounded(spark):
    rows = spark.createDataFrame([(1, "One. The plan  renews soon.\nTwo"), (2, None)], "id long, body string")
    assert [s["tool"] for s in operators.ask(rows, "q", "renews")] == ["search", "read", "quote", "answer"]
    assert operators.ask(rows, "q", "renews")[-1]["answer"] == "The plan renews soon"
    assert [s["tool"] for s in operators.ask(rows, "q", "zebra")] == ["search"]
    assert len(operators.ask(rows, "q", "renews", 2)) == 2


def test_neighbours_in_blocks(spark, monkeypatch):
    """Many small blocks and batches give what one gives; nulls, ties and zero vectors."""
    rows = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 3)] if k != 7 else [0.0, 0.0, 0.0], k % 2) for k in range(60)] + [(99, None, 1)], "vec_id long, embedding array<float>, label int").repartition(5)
    whole = sorted(map(tuple, vectors.neighbours(rows, rows, 4).collect()), key=str)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 9)
    assert sorted(map(tuple, vectors.neighbours(rows, rows, 4).collect()), key=str) == whole
    assert len(whole) == 60 * 4 and all(a[0] != a[2] for a in whole)
    assert vectors.neighbours(rows, rows.limit(0)).count() == 0 and vectors.neighbours(rows.limit(0), rows).count() == 0


def test_history_of_a_message(spark):
    mails = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "account string, id long")
    feedback = spark.createDataFrame([("a", 1, k, f"label{k}") for k in range(60)] + [("b", 1, 99, "other")], "account string, id long, number long, label string")
    attempts = spark.createDataFrame([("a", 2, 1, "classify")], "account string, id long, number long, stage string")
    got = operators.history(mails, "a", 1, feedback=feedback, attempts=attempts)
    assert [r.number for r in got["feedback"].collect()] == list(range(59, 9, -1)) and got["attempts"].count() == 0 and got["feedback"].columns == ["number", "label"]
    with pytest.raises(LookupError):
        operators.history(mails, "b", 2, feedback=feedback)


def test_status_of_accounts(spark):
    tasks = spark.createDataFrame([("a", "queued", "live"), ("a", "retry", "backlog"), ("a", "dead", "live"), ("b", "complete", None), (None, "queued", "live")], "account string, status string, source string")
    index = spark.createDataFrame([("a", "pending"), ("c", "indexed"), ("c", None)], "account string, state string")
    jobs = spark.createDataFrame([("a", k, "down" if k > 3 else None) for k in range(6)] + [("b", 1, "ok")] + [("d", k, "down") for k in range(40)], "account string, number long, code string")
    got = {r.account: r for r in operators.status(tasks, index, jobs, ["down"]).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    a, d = got["a"], got["d"]
    assert (a.tasks, a.active, a.finished, a.active_live, a.active_backlog, a.pending, a.failed_checks, a.retry_seconds) == (3, 2, 1, 1, 1, 1, 2, 10)
    assert (got["b"].failed_checks, got["b"].retry_seconds, got["c"].indexed, d.failed_checks, d.retry_seconds, d.tasks) == (0, None, 1, 30, 60, 0)
