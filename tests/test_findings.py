"""Queries over small tables of odd rows, against their SQL by DuckDB."""

import datetime
import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog
from tessera.plans.dialect import TABLES


def both(spark, tmp_path, name, tables):
    """A query's rows and its SQL's, over tables: name -> (rows, DDL); the others are the smallest ones."""
    con = duckdb.connect()
    for t in set(TABLES) - set(tables):
        Path(f"{tmp_path}/{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    for t, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = catalog.queries()[name](spark, str(tmp_path))
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    return Counter(map(tuple, df.collect())), Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_names_are_near_by_bytes(spark, tmp_path):
    names = ["strömko", "stromko", "strömkö", "stramko", "strämko", "josé", "josè", "jose", "ana", "anna", "日本", "日木", "ŝan", "ñan"]
    got, want = both(spark, tmp_path, "c15_near_client_names", {"clients": ([(k, n) for k, n in enumerate(names)], "client_id long, name string")})
    assert got == want and ("stramko", "stromko") in got and ("stromko", "strömko") not in got and ("josè", "josé") in got


def test_sales_whose_clicks_have_no_kind(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 3, 1, 12, m)
    sales = [(1, 7, at(30)), (2, 8, at(30)), (3, 9, at(30)), (3, 7, at(31)), (4, 5, at(30))]
    clicks = [(1, 7, at(10), None), (2, 8, at(10), None), (3, 8, at(11), "purchase"), (4, 9, at(12), "view")]
    got, want = both(spark, tmp_path, "interval_clicks_before_sales", {"sales": (sales, "sale_id long, client_id long, sold_at timestamp_ntz"), "clicks": (clicks, "click_id long, client_id long, ts timestamp_ntz, kind string")})
    assert got == want and got[(1, 1, None)] == 1 and got[(2, 2, 1)] == 1


def test_sessions_keep_clicks_of_one_time_together(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 3, 1, h, m)
    clicks = [(1, 7, at(9, 0), "view"), *((k, 7, at(12, 0), "view") for k in range(2, 40)), (40, 7, at(12, 20), "view")]
    spark.createDataFrame(clicks, "click_id long, client_id long, ts timestamp_ntz, kind string").write.parquet(f"{tmp_path}/clicks.parquet")
    got = catalog.queries()["client_sessions"](spark, str(tmp_path)).orderBy("began").collect()
    assert [r.n for r in got] == [1, 39]


@pytest.mark.parametrize("name", ["h20_safe_text", "redacted_documents", "k3_amount_tags", "k6_mail_left"])
def test_neighbours_under_masks(spark, tmp_path, name):
    texts = ["4539 5787 6362 +49 (30) 1234567", "a@b.example x@y.example w@v.example", "me@upi you@upi us@upi", "ABCDE1234F ABCDE1234F ABCDE1234F", "1234 5678 030 1234 5678 +44 20 7946 0958", "1234 5678\n+49 30 1234567", None]
    got, want = both(spark, tmp_path, name, {"documents": ([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")})
    assert got == want


def test_parts_of_many_files_make_as_many_batches(spark, tmp_path):
    """A part is written and read by as many tasks as its table is, and still is one batch."""
    from tessera.streaming import folds

    spark.range(4000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    for source in (folds.arriving(spark, str(tmp_path), "events", "event_id"), folds.parted(spark, str(tmp_path))):
        batches = []

        def note(batch, _, batches=batches):
            batches.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))

        source.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/state{len(seen)}").trigger(availableNow=True).start().awaitTermination()
        seen.append(batches)
    assert [len(b) for b in seen] == [4, 6] and all(files > 1 for b in seen for _, files in b)
    assert [sum(n for n, _ in b[:-1]) for b in seen] == [4000, 4000]


def test_what_was_told_is_not_broadcast(spark):
    from tessera.streaming import folds

    rows = spark.range(100).selectExpr("id AS event_id")
    assert "Broadcast" not in folds.unseen(rows, rows.where("event_id < 50"))._jdf.queryExecution().executedPlan().toString()


def test_what_was_claimed_is_not_broadcast(spark):
    from tessera.streaming import delivery

    bus, runs = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    box = delivery.Outbox(spark, "id", lambda claims, number: claims)
    box.claim(spark.range(100), 0)
    bus.waitUntilEmpty()
    before = runs.executionsList().size()
    box.claim(spark.range(50, 150), 1)
    bus.waitUntilEmpty()
    plans = [runs.executionsList().apply(i).physicalPlanDescription() for i in range(before, runs.executionsList().size())]
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert sorted(r.id for r in spark.read.parquet(f"{box.root}/claims/round=1").collect()) == list(range(100, 150))


def test_events_are_told_once_without_python(spark, tmp_path):
    from tessera.streaming import keyed

    for k in (0, 1):
        spark.range(50 * k, 50 * k + 100).selectExpr("id AS event_id", "'view' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    assert "Python" not in keyed.once(stream, "event_id", 24)._jdf.queryExecution().analyzed().toString()
    with keyed.rocks(spark, idle=False):
        keyed.once(stream, "event_id", 24).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(150))


def test_nearest_rows_in_small_parts(spark):
    """Batches of any size are multiplied in bounded parts, what can't be told is dropped, and the nearest stay those of all pairs."""
    import numpy as np
    import pyarrow as pa

    from tessera.plans import vectors

    vectors_ = pa.array([[1.0, 2.0], None] * 3000, pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), vectors_, pa.array([1] * 6000)], ["vec_id", "embedding", "label"])
    parts = list(vectors.parts_of(iter([batch, batch.slice(0, 0)])))
    assert sum(p.num_rows for p in parts) == 3000 and max(p.num_rows for p in parts) <= vectors.ROWS
    q = np.array([1, 2, 3])
    best = (np.array([1, 1, 3]), None, None, None, np.array([0.1, 0.4, 0.2]))
    assert vectors.last_kept(q, best, 2).tolist() == [0.4, np.inf, np.inf]
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(2)
    got = {(r.q, r.rn): (r.id, r.d) for r in vectors.neighbours(df, df.where("vec_id % 2 = 0"), 200, 1.5).collect()}
    u = vectors.matrix(pa.array([np.float32(v).tolist() for v in x]))
    for k in range(0, 3000, 500):
        d = np.round(1 - u @ u[k], 9)
        order = [j for j in np.lexsort((np.arange(3000), d)) if j != k and d[j] <= 1.5][:200]
        assert np.abs(np.array([got[(k, n + 1)][1] for n in range(len(order))]) - d[order]).max() < 1e-6 and (k, len(order) + 1) not in got


def test_texts_go_through_python_in_small_parts(spark):
    import inspect

    from tessera.functions import mail
    from tessera.plans import scalar

    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 9 <> 0 THEN concat('cafe\\u0301 ', id) END AS text")
    got = {r.id: r.text for r in mail.per_part(df, mail.composed, "text string").collect()}
    assert got == {k: f"café {k}" if k % 9 else None for k in range(1000)}
    assert mail.per_part(df.limit(0), mail.composed, "text string").count() == 0
    assert all("per_part" in inspect.getsource(f) for f in (scalar.h1_normal_form, scalar.h21_numbered_masks))


def test_sentence_begins_once():
    """Only the beginning of a sentence is tried: text that ends without a stop was gone over from each of its places."""
    from tessera.plans import signals
    from tessera.plans.dialect import DUCK, SPARK

    assert "(?<!" in signals.h18_sentence_around(SPARK) and "(?<!" not in signals.h18_sentence_around(DUCK)


def test_totals_make_each_text_once(spark, tmp_path):
    """A filter by kind went down to where the texts are read, and made each text for every word of a kind."""
    rows = [(k, f"Paid {k}.50 usd | total: Rs {k + 1}", "refunds" if k % 24 == 6 else None if k % 24 == 9 else f"s{k % 2}", "en") for k in range(60)]
    got, want = both(spark, tmp_path, "o6_tool_totals", {"documents": (rows, "doc_id long, text string, source string, lang string")})
    assert got == want and [r[3:6] for r in got if r[0] == "refunds"] == [(None, None, 0)]
    plan = catalog.queries()["o6_tool_totals"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[ \t\r]{2,}") == 2


def test_headers_are_read_once(monkeypatch):
    """A header is read once, not at each look, and messages are written and read as by the default policy."""
    import email
    import email.policy
    import random
    from email import headerregistry

    import pandas as pd

    from tessera.functions import mail

    read = []
    for kind in (headerregistry.ContentTypeHeader, headerregistry.UnstructuredHeader):
        plain = kind.value_parser
        monkeypatch.setattr(kind, "value_parser", staticmethod(lambda v, plain=plain: read.append(v) or plain(v)))
    shapes = [0, 1, 2, 3, 4, 5] * 4
    subject = ["a fresh header of F11", "größer, " * 30, "=?utf-8?b?w6k=?= twice " * 9, "x" * 3000]
    args = [pd.Series(x) for x in (range(24), ["Ada <ada@f11.example.com>"] * 24, ["größer" if k % 6 == 4 else subject[k // 6] for k in range(24)], ["text\r\nof é"] * 24, shapes)]
    made = []
    for policy in (mail.POLICY, email.policy.default):
        random.seed(7)
        monkeypatch.setattr(mail, "POLICY", policy)
        read.clear()
        raw = mail.raw_message.func(*args)
        made.append((raw.tolist(), mail.parse_message.func(raw).values.tolist(), len(read)))
    assert made[0][:2] == made[1][:2] and made[0][2] * 4 < made[1][2]


def test_places_of_words_are_counted_within_rows(spark, tmp_path):
    """What is grouped is a row a document: a row a place of each document filled a task's memory."""
    texts = [(1, "one two two Größe größe 日本 x1"), (1, "two again"), (2, None), (3, ""), (4, "..."), (None, "no id"), (None, "id"), (5, "w " * 5000 + "v"), (6, " ".join(f"word{k}" for k in range(3000)))]
    got, want = both(spark, tmp_path, "j1_embedded_documents", {"documents": (texts, "doc_id long, text string")})
    assert got == want and {r[0] for r in got} == {1, None, 5, 6}
    plan = catalog.queries()["j1_embedded_documents"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_names_are_not_broadcast_by_their_file(spark):
    """A small file of names is many times larger once dealt under what deletions leave."""
    from tessera.plans import near

    df = near.within(spark.createDataFrame([("anna",), ("ana",), ("bob",)], "name string"), spark.createDataFrame([("anna",), ("hanna",)], "name string"))
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("ana", "anna", 1), ("anna", "anna", 0), ("anna", "hanna", 1)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_are_of_whole_texts(spark, tmp_path):
    long = "cafe\u0301 " * 9000
    texts = [long + "end", long + "END", long + " \r\n\n\n\n x \n\n", "\n" * 40000 + "x", "x " * 16000 + "\n\n\ny", "", None]
    rows = [(k, t) for k, t in enumerate(texts)]
    got, want = both(spark, tmp_path, "h1_normal_form", {"documents": (rows, "doc_id long, text string")})
    forms = dict(list(got))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == want and len({forms[k] for k in range(3)}) == 3
    assert forms[0] == sha("café " * 9000 + "end") and forms[2] == sha("café " * 8999 + "café\n\nx") and forms[4] == sha("x " * 15999 + "x\n\ny") and forms[6] is None


ODD = ["paid $5 " * 30 + "x " * 25000 + "total: $777", "a" * 7000 + " order total Rs 1,234.50 me@x.example", "x $1. y £2.50|z 3 inr,\n\n\n €4 " * 9 + "z. " + "b  \f c" * 9000 + " total $12.30. end", "one $5", "$5 " * 300 + "grand total: $6.", "é₹5€6$7 usd 8 eur 9,99,999.999 rs.1.5.5 $99999999999999999999999999999999999 $0 5 inr6 inr", "", "no money " * 5000, None]


def odd_messages(rows=ODD):
    """Texts under ids whose messages come with amounts and without."""
    return {"documents": ([(24 * k + c, t, f"s{k % 2}", "en") for k, t in enumerate(rows) for c in (0, 4, 5)], "doc_id long, text string, source string, lang string")}


def test_all_amounts_get_tags(spark, tmp_path):
    got, want = both(spark, tmp_path, "k3_amount_tags", odd_messages())
    tags = {r[0]: r[2] for r in got}
    assert got == want and [tags[24 * k + 4] for k in (0, 1, 3, 4)] == [31, 1, 1, 301]


def test_records_are_of_all_amounts(spark, tmp_path):
    """Totals behind the twentieth amount and the 40,000th character, and what is said of a renewal there."""
    late = "b " * 25000
    rows = [*ODD, "$5 " * 30 + late + "\ntotal: $777", "$1 " * 25 + "| " + "x " * 300 + "order total: $9. y", late + "\nyour subscription renews on 5 November 2031 monthly, $3", ". \f" * 3 + "a\f " * 500 + "total $4 b" * 2]
    got, want = both(spark, tmp_path, "k7_records", odd_messages(rows))
    found = {r[0]: r for r in got}
    assert got == want and max(got.values()) == 1
    n = len(ODD)
    assert [found[24 * k + 4][2] for k in (0, 2, 4, n, n + 1)] == [500, 1230, 600, 77700, 900]
    assert found[24 * (n + 2) + 4][5:7] == (datetime.date(2031, 11, 5), "monthly")
    assert len(found[24 * (n + 1) + 4][7]) == 200 and found[24 * n + 4][7] == "total: $777"


def test_totals_of_tools_are_of_whole_texts(spark, tmp_path):
    late = "b " * 25000
    rows = ["$5 " * 25 + "| " + "x " * 60 + "order total: $9", late + "paid $7", late + "refund of $8", late, *ODD]
    got, want = both(spark, tmp_path, "o6_tool_totals", {"documents": ([(24 * k + 4, t, f"s{k}", "en") for k, t in enumerate(rows)], "doc_id long, text string, source string, lang string")})
    spent = {r[0]: r[3:6] for r in got}
    assert got == want and [spent[f"s{k}"] for k in range(4)] == [("USD", 900, 1), ("USD", 700, 1), (None, None, 0), (None, None, 0)]
