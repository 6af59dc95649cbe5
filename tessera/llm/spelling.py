"""Operator 13: spelling variants, by forward and backward minimal acyclic automata.

Two words are near if they differ by one inserted, deleted or replaced code point. A word of L code points splits at
L // 2: whatever the one difference is, the first half stands as it is in the near word's beginning, or the second half in
its end. So words are dealt by their halves, once forward and once backward (reversed): as one to be found under each half
that a word of about its length may have, as one that asks under its own. A shard of whole halves is read in order: its
words to be found become a minimal acyclic automaton whose states count their words, so that a path gives a word's number,
by which occurrences are looked up. Those that ask walk their half exactly and the rest with one difference at the first
place where the words part, so that each near word is found once; what both directions find counts forward only. Nothing
but each word's count and best near word leaves a shard. Halves that more than WORDS words share are dealt in parts by the
words' hash, and ask in each part; a shard holds about WORDS words.

A word's form is its near word that occurs most, if that is at least twice as often; roots follow the forms, by jumps that
double (a form occurs twice as often, so chains are short: 6 rounds of one join at most for 2 ** 63 occurrences).

Defined cases: null texts have no words; a null doc_id counts as an empty one; repeated rows count each; words of any
length are taken; ties of forms go to the smallest word in code point order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import table, written

#: Code points and occurrences that a word has at least; words to be found in a shard.
LEAST, TIMES, WORDS = 5, 3, 50_000
#: Of the runs whose hash this divides, one code point is taken out.
DIVISOR = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs (doc_id, text) -> word, n."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least)  # shorter ones can only become shorter
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.expr("CAST(h % length(run) AS INT)")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a path's skips add up to its word's number."""

    def __init__(self, words: Iterable[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []  # of a state: letter -> next state, words before that arc
        self.final: list[bool] = []
        self.counts: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # states that may still grow: whether a word ends here, then letter, state, letter, state, ...
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, before, same, known)
            path.extend([False] for _ in range(len(word) - same))
            path[-1][0] = True
            before = word
        self._close(path, before, 0, known)
        self.start = self._state(path[0], known)

    def _close(self, path: list[list], word: str, depth: int, known: dict[tuple, int]) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop(), known)
            path[-1] += (word[len(path) - 1], state)

    def _state(self, open_: list, known: dict[tuple, int]) -> int:
        key = tuple(open_)
        at = known.get(key)
        if at is None:
            known[key] = at = len(self.arcs)
            n, arcs = int(key[0]), {}
            for letter, to in zip(key[1::2], key[2::2], strict=True):
                arcs[letter] = (to, n)
                n += self.counts[to]
            self.arcs.append(arcs)
            self.final.append(key[0])
            self.counts.append(n)
        return at

    def _rest(self, state: int, word: str, at: int) -> int:
        """The number that the rest of a word adds from a state, or -1."""
        arcs, number = self.arcs, 0
        for k in range(at, len(word)):
            step = arcs[state].get(word[k])
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> list[int]:
        """Numbers of the words that share the first half and differ by one at the first place where they part."""
        arcs, rest = self.arcs, self._rest
        state, number, end, found = self.start, 0, len(word), []
        for k, letter in enumerate(word):
            if k >= half:
                for other, (to, skip) in arcs[state].items():
                    if other != letter:
                        if (r := rest(to, word, k + 1)) >= 0:  # replaced
                            found.append(number + skip + r)
                        if (r := rest(to, word, k)) >= 0:  # inserted
                            found.append(number + skip + r)
                if (k + 1 == end or word[k + 1] != letter) and (r := rest(state, word, k + 1)) >= 0:  # deleted
                    found.append(number + r)
            step = arcs[state].get(letter)
            if step is None:
                return found
            state = step[0]
            number += step[1]
        for to, skip in arcs[state].values():  # one more at the end
            if self.final[to]:
                found.append(number + skip)
        return found


#: Rows of a shard: backward (the item is reversed), asks, item, its occurrences, hash; of one that asks: its half, the part it asks and of how many.
SHARD = "shard long, backward boolean, asks boolean, item string, n long, hash long, half int, part int, parts int"
FOUND = "word string, near string, near_n long, n_near long"


def searched(pairs: bool):
    """A mapInArrow function over rows sorted by shard, direction, asks, item: for each that asks its near words' number and the best (or all of them, a row each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts, hashes, found = None, [], [], [], None
        for batch in batches:
            out = []
            for shard, backward, asks, item, n, hash_, half, part, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (shard, backward):
                    now, words, counts, hashes, found = (shard, backward), [], [], [], None
                if not asks:
                    if not words or words[-1] != item:  # an item may come under two halves
                        words.append(item)
                        counts.append(n)
                        hashes.append(hash_)
                    continue
                if found is None:
                    found = Automaton(words)
                best, k = None, 0
                # what the forward search finds as well begins with the other half: item[-(length - half):] is its mirror image
                other = item[half:]
                for number in found.near(item, half):
                    if parts > 1 and hashes[number] % parts != part:
                        continue
                    near = words[number]
                    if backward:
                        if near.endswith(other):
                            continue
                        near = near[::-1]
                    k += 1
                    if pairs:
                        out.append((item[::-1] if backward else item, near, counts[number], 1))
                    elif best is None or (-counts[number], near) < best:
                        best = (-counts[number], near)
                if best is not None:
                    out.append((item[::-1] if backward else item, best[1], -best[0], k))
            if out:
                word, near, near_n, n_near = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64()), pa.array(n_near, pa.int64())], ["word", "near", "near_n", "n_near"])

    return run


def dealt(words: DataFrame, size: int = WORDS) -> DataFrame:
    """words (word, n) -> the rows of SHARD."""
    length, hash_ = F.length("word"), F.pmod(F.xxhash64("word"), F.lit(1 << 31))

    def rows(backward: bool) -> DataFrame:
        item = F.reverse("word") if backward else F.col("word")
        half = lambda n: ((n + 1) / 2 if backward else n / 2).cast("int")
        df = words.select(F.lit(backward).alias("backward"), item.alias("item"), "n", hash_.alias("hash"), half(length).alias("half"), F.array_distinct(F.array(half(length - 1), half(length), half(length + 1))).alias("halves"))
        sought = df.select("backward", F.lit(False).alias("asks"), "item", "n", "hash", F.explode("halves").alias("half"))
        asking = df.select("backward", F.lit(True).alias("asks"), "item", "n", "hash", "half")
        return sought.unionByName(asking).withColumn("key", F.expr("substring(item, 1, half)"))

    df = rows(False).unionByName(rows(True))
    sizes, _ = written(df.where("not asks").groupBy("backward", "key").agg(F.count(F.lit(1)).alias("sought")), "halves")
    total = sizes.agg(F.coalesce(F.sum("sought"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // size))
    hot = sizes.where(F.col("sought") > size).select("backward", "key", F.ceil(F.col("sought") / size).cast("int").alias("parts"))
    if hot.isEmpty():
        df = df.withColumn("part", F.lit(0)).withColumn("parts", F.lit(1))
    else:
        df = df.join(hot, ["backward", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        each = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod("hash", "parts").cast("int")))
        df = df.withColumn("part", F.explode(each))
    shard = F.pmod(F.xxhash64("backward", "key", "part"), F.lit(shards))
    return df.select(shard.alias("shard"), "backward", "asks", "item", "n", "hash", "half", "part", "parts").repartition(shards, "shard").sortWithinPartitions("shard", "backward", "asks", "item")


def near_words(words: DataFrame, size: int = WORDS) -> DataFrame:
    """words (word: distinct, n) -> all pairs: word, near, near_n."""
    return dealt(words, size).mapInArrow(searched(True), FOUND).select("word", "near", "near_n")


def formed(words: DataFrame, size: int = WORDS) -> DataFrame:
    """words (word: distinct, n) -> word, n, n_near, form, form_n."""
    found = dealt(words, size).mapInArrow(searched(False), FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    df = words.join(best, "word", "left")
    often = -F.col("best.less") >= 2 * F.col("n")
    return df.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form) of words that have one -> word, root: each jump goes where the place it leads to goes, till none moves."""
    links, _ = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while not links.where("moved").isEmpty():
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        links, _ = written(links.join(ahead, links["root"] == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
    return links.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, size: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> word, n, n_near, form, form_n, root."""
    words, _ = written(counted(docs, least, times), "words")
    forms, _ = written(formed(words, size), "forms")
    roots = rooted(forms.where("form is not null")).withColumnRenamed("word", "of")
    return forms.join(roots, forms["word"] == roots["of"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_halves_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    from tessera.llm.layout import REMAINDERS, crc32

    return rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), named AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS t, count(*) AS times, {REMAINDERS} AS k FROM runs WHERE length(run) >= {LEAST} GROUP BY run, t
), hashed AS (SELECT run, times, {crc32("t", "k")} AS h FROM named
), cut AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed
), words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {TIMES}
), places AS (SELECT word, unnest(range(length(word))) AS i FROM words
), gaps AS (SELECT DISTINCT word, word[1:i] || word[i + 2:] AS gap FROM places
), near AS (
  SELECT a.word, b.word AS near FROM (SELECT word, word[1:i] || '?' || word[i + 2:] AS hole FROM places) a JOIN (SELECT word, word[1:i] || '?' || word[i + 2:] AS hole FROM places) b USING (hole) WHERE a.word <> b.word
  UNION SELECT gaps.word, words.word FROM gaps JOIN words ON gap = words.word
  UNION SELECT words.word, gaps.word FROM gaps JOIN words ON gap = words.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(row(w.n, near.near) ORDER BY w.n DESC, near.near) AS b FROM near JOIN words w ON w.word = near.near GROUP BY near.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b[1] >= 2 * w.n THEN b[2] END AS form, CASE WHEN b[1] >= 2 * w.n THEN b[1] END AS form_n FROM words w LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root, 0 AS depth FROM forms UNION ALL SELECT r.word, f.form, r.depth + 1 FROM roots r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, arg_max(root, depth) AS root FROM roots GROUP BY word) r USING (word)
"""


ORACLE = _oracle()
