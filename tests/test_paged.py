"""Pages, tokens, cursors and restarts of the mailbox sources."""

import json

import pytest

from tessera.sources import paged


def lines(folder, *rows):
    folder.mkdir(parents=True)
    (folder / "rows.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_pages_follow_their_tokens(spark, tmp_path):
    lines(tmp_path / "account=a/block=0", {"token": 3, "ids": [30, 29]}, {"token": 2, "ids": [20]}, {"token": 0, "ids": [1]})
    lines(tmp_path / "account=b/block=1", {"token": 201, "ids": [9], "next": 7})
    lines(tmp_path / "account=b/block=0", {"token": 7, "ids": [8], "next": None})
    skip = spark.createDataFrame([(20,), (20,), (99,)], "id long")
    got = sorted(map(tuple, paged.listed(spark, f"file://{tmp_path}", skip).collect()))
    assert got == [("a", 0, 0, 30), ("a", 0, 1, 29), ("a", 3, 0, 1), ("b", 0, 0, 9), ("b", 1, 0, 8)]
    assert {r.page for r in paged.listed(spark, f"file://{tmp_path}", skip, 1).collect()} == {0}
    assert paged.listed(spark, f"file://{tmp_path}/none", skip).count() == 0


def test_a_token_that_comes_again_is_an_error(spark, tmp_path):
    lines(tmp_path / "account=a/block=0", {"token": 3, "ids": [1], "next": 2}, {"token": 2, "ids": [2], "next": 3})
    with pytest.raises(Exception, match="came again"):
        paged.listed(spark, f"file://{tmp_path}", spark.createDataFrame([], "id long")).collect()


def test_history_from_a_committed_offset(spark, tmp_path):
    root, got = tmp_path / "history", {}

    def run(**options):
        # a batch that is run again takes its own place
        stream = paged.followed(spark, f"file://{root}", **options).writeStream.foreachBatch(lambda rows, n: got.__setitem__(n, sorted(r.number for r in rows.collect())))
        stream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    row = lambda n: {"number": n, "account": n % 3, "kind": "added"}
    lines(root / "segment=0", *(row(n) for n in range(0, 900, 3)))
    run(cap=100_000)
    lines(root / "segment=1", *(row(n) for n in range(1000, 1500)))
    run()
    run()
    lines(root / "segment=3", row(3001), row(3000))
    run()
    told = [n for batch in sorted(got) for n in got[batch]]
    assert told == [*range(0, 900, 3), *range(1000, 1500), 3000, 3001] and len([b for b in got.values() if b]) == 3


def test_an_old_cursor_is_refused(tmp_path):
    lines(tmp_path / "segment=5", {"number": 5001, "account": 1, "kind": "added"})
    reader = paged.HistoryReader({"path": f"file://{tmp_path}", "after": "17"})
    with pytest.raises(paged.Expired):
        reader.partitions(reader.initialOffset(), reader.latestOffset())
    # a cap bounds how far one batch goes
    capped = paged.HistoryReader({"path": f"file://{tmp_path}", "after": "4990", "cap": "4"})
    capped.commit(capped.initialOffset())
    assert capped.latestOffset() == {"seen": 4994}
