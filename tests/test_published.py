import pytest

from tessera.functions import training
from tessera.sources import published


def test_lines_come_back(spark):
    rows = [(1, "a\nb", None), (2, None, 1.5), (3, "", 0.0)]
    df = spark.createDataFrame(rows, "i long, s string, v double")
    assert sorted(map(tuple, published.json_lines(df, "t").collect())) == rows
    assert published.json_lines(df.where("i > 9"), "t").count() == 0


def test_versions(spark):
    df = spark.createDataFrame([(1, 0, None)], "conv_id long, turn long, text string")
    newest = published.migrated(df, "conversations", 1)
    assert newest.first().asDict() == {"conv_id": 1, "turn": 0, "text": None, "archived": False, "n_chars": 0, "label": "first"}
    assert published.migrated(newest, "conversations", 4).columns == newest.columns
    for have in (0, 5, 2):
        with pytest.raises(ValueError):
            published.migrated(df, "conversations", have)


def test_training_learns(spark):
    rows = [("pay now please", 1, i % 3 == 0) for i in range(30)] + [("lunch at noon", 0, i % 3 == 0) for i in range(30)] + [(None, 0, False), ("x", None, True)]
    model, scores = training.train(spark.createDataFrame(rows, "text string, label int, validation boolean"), (1, 4))
    assert model is not None and max(s for _, s in scores) == 1.0


def test_broken_lines_are_refused(spark):
    from tessera.sources import files

    path = published.workspace(spark, "lines")
    lines = ['{"id": 1, "line": 1, "answer": "a"}', '{"id": 1, "line": 3, "answer": "c"} {', '{"id": 1, "line": 2, "answer": "b"}', '{"id": 2, "line": 1, "answer": "x"} {"id": 2}', '{"id": 3, "li', "", "[]", "null", '  {"id": 4, "line": 1, "answer": null}  ', '{"line": 5}', '{"id": "text", "line": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    assert sorted(map(tuple, files.recorded(spark, path, "id long, line long, answer string", "id", "line").collect())) == [(1, 2, "b"), (4, 1, None)]
