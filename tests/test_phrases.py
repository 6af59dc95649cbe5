"""Phrases in texts against a plain search."""

import random

import pytest

from tessera.plans import phrases


def plain(docs, items):
    return sorted((p, i) for p, q in items if q for i, s in docs if s is not None and q in s)


@pytest.mark.parametrize("seed", range(2))
def test_phrases_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "abc", "abcd", "bcd", "éa", "xyz", "aab"]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, words(rng.randrange(40))) for k in range(60)] + [(100, None), (101, ""), (3, "abcd again"), (3, "abcd again")]
    items = []
    for k in range(80):
        s = rng.choice(docs)[1] or ""
        at = rng.randrange(len(s) + 1)
        # a piece of a text, cut anywhere, or words that may stand nowhere
        items.append((k, rng.choice([s[at : at + rng.choice([1, 2, 3, 5, 9, 30])].strip(), words(rng.randrange(1, 8))])))
    items += [(200, None), (201, ""), (202, "abcd"), (202, "abcd")]
    for some in (items, items[:1] + items[-2:], [i for i in items if len((i[1] or "").split()) > 3], []):
        got = phrases.found(spark.createDataFrame(docs, "id long, s string").repartition(3), spark.createDataFrame(some, "pid long, q string"))
        assert sorted(map(tuple, got.collect())) == plain(docs, some)


def test_no_nested_loop(spark):
    text = phrases.grounded_quotes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
