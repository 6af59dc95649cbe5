"""Operator 2: benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become one automaton; a document's words are streamed through it, which
yields at each word the longest match that ends there. A match of n words or more ends in a
window; the state cut back to n words knows the items that hold the window, and an item of fewer words
is met as a whole. Words that no item has reset the automaton, so only runs of known words
are streamed, and only runs as long as the shortest window.

The automata are bounded: items are cut into overlapping pieces of PIECE words (overlap n - 1, so that
no window is lost) and dealt by hash into shards of about SHARD words, equal pieces of an item once; documents pass over
each shard and the hits are united. A task holds AT_ONCE shards; beyond those the documents, with their hits so far,
are written to the shared folder and pass over the next ones.

``remove`` takes spans out: those of ``longest`` words or more, and all of a document whose hits cover 1 / coverage of it.

Defined cases: null text and null items have no words; a null item_id counts as a hit but is not
listed; equal items are listed each; an item shorter than n is one window; an empty benchmark hits
nothing; rows that repeat are kept and judged alike; ``clean`` keeps other columns, whatever their names, the others
ignore them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.base import WORDS, column_bytes, mapped, per_batch, table, written

N = 13
SHARD = 100_000
PIECE = 20_000
AT_ONCE = 2
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
HITS = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))])
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class Automaton:
    """Of several word sequences, each with the id of its item."""

    def __init__(self, pieces: list[tuple[str | None, bool, list[bytes]]], n: int):
        """pieces: item id, whether the piece is a whole item, its words."""
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = defaultdict(set)
        self.ids: list[str | None] = []
        shortest = n
        wholes: list[tuple[int, list[int]]] = []
        for item, whole, words in pieces:
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(item)
            ws = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for w in ws:
                last = self._extend(last, w)
                ends[last].add(at)
            if len(ws) < n and whole:
                wholes.append((at, ws))
                shortest = min(shortest, len(ws))
        self.shortest = shortest
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in order:  # an item that ends in a state ends in the state's suffixes
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, ws in wholes:
            v = 0
            for w in ws:
                v = self.next[v][w]
            short[v].append((len(ws), at))
        #: For each state: the short items that its matches end with, and the state of their last n words.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        self.cut = [0] * len(self.link)
        for v in reversed(order):
            up = max(self.link[v], 0)
            self.short[v] = self.short[up] + tuple(short.get(v, ()))
            self.cut[v] = (self.cut[up] if self.length[up] >= n else v) if self.length[v] >= n else 0
        self.items = {v: frozenset(ends[v]) for v in set(self.cut) if v}

    def _extend(self, last: int, w: int) -> int:
        """One more word after the state last, with the usual reuse of states that other items made."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, q, w)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (united, end exclusive) and the positions in ids of the items found."""
        known = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, n, cut, short = self.next, self.link, self.length, self.n, self.cut, self.short
        for k in np.flatnonzero(stops - starts >= self.shortest):
            v = size = 0
            for i, w in enumerate(known[starts[k] : stops[k]].tolist(), int(starts[k]) + 1):
                while v and w not in nxt[v]:
                    v = link[v]
                    size = length[v]
                v = nxt[v].get(w, 0)
                size = size + 1 if v else 0
                if size >= self.shortest:
                    if size >= n:
                        found |= self.items[cut[v]]
                        spans.append((i - n, i))
                    for m, at in short[v]:
                        if m <= size:
                            found.add(at)
                            spans.append((i - m, i))
        return united(spans), found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces_of(items: DataFrame, n: int) -> DataFrame:
    """items (item_id, text) -> item, whole, words (space-joined), in pieces of bounded size."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                ws = words_of(text)
                for at in range(0, max(1, len(ws) - n + 1), PIECE):
                    rows.append((item, len(ws) < n, b" ".join(ws[at : at + PIECE + n - 1]), len(ws[at : at + PIECE + n - 1])))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.binary(), pa.int64()), strict=True)], ["item", "whole", "words", "n"])

        return one

    source = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return source.mapInArrow(per_batch(make), "item string, whole boolean, words binary, n long").where("n > 0")


def _automata(items: DataFrame, n: int) -> tuple[int, Iterator[Automaton]]:
    """How many automata there are, and one after the other, each of bounded size."""
    pieces = pieces_of(items, n).distinct()
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def built(k: int) -> Automaton:
        own = pieces if shards == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == k)
        rows = sorted(((r.item, r.whole, bytes(r.words)) for r in own.collect()), key=lambda r: (r[0] is None, r))
        return Automaton([(i, w, ws.split()) for i, w, ws in rows], n)

    return shards, map(built, range(shards))


def matched(docs: DataFrame, items: DataFrame, n: int = N) -> tuple[DataFrame, str]:
    """docs with the hits of all shards (HITS) in one more column, and its name, which is longer than any other."""
    spark, names = docs.sparkSession, docs.columns
    at, own = names.index("text"), "__hits" + "_" * max(map(len, names))
    shards, automata = _automata(items, n)

    def make(held: list):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            before = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else repeat(None)
            out = []
            for text, old in zip(batch.column(at).cast(pa.binary()).to_pylist(), before):
                ws = words_of(text)
                spans, ids = ([(s["start"], s["end"]) for s in old["spans"]], set(old["items"])) if old else ([], set())
                for h in held:
                    found, which = h.value.match(ws)
                    spans += found
                    ids |= {h.value.ids[x] for x in which} - {None}
                out.append({"n_words": len(ws), "spans": [{"start": a, "end": b} for a, b in united(spans)], "items": sorted(ids)})
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, _HITS)], [*batch.schema.names[: len(names)], "hits"])

        return one

    for first in range(0, shards, AT_ONCE):
        held = [spark.sparkContext.broadcast(a) for a in islice(automata, AT_ONCE)]
        old = docs.columns[len(names) :]
        docs = mapped(docs, partial(make, held), *([] if old else [StructField(own, HITS)]))
        if first + AT_ONCE < shards:
            docs, _ = written(docs, "hits")
            for h in held:
                h.destroy()
    return docs, own


def find(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, text, n_words, spans (of words, end exclusive), items (sorted ids)."""
    found, own = matched(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, n)
    return found.select("doc_id", "text", f"{own}.*")


def hits(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit, n_words, coverage: int = 20) -> F.Column:
    return (n_hit > 0) & (F.lit(coverage) * n_hit >= n_words)


def remove(docs: DataFrame, items: DataFrame, n: int = N, longest: int = N, coverage: int = 20) -> DataFrame:
    """find's columns without text, contaminated, n_removed (words) and left: the text without the hit spans of ``longest`` words or more, of documents whose hits cover 1 / coverage of the words without any."""
    names = ["doc_id", "text", "n_words", "spans", "items", "contaminated"]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, gone_words = [], []
            for text, spans, all_ in zip(column_bytes(batch, "text"), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                gone = [(s["start"], s["end"]) for s in spans if all_ or s["end"] - s["start"] >= longest]
                if gone:
                    at = [(m.start(), m.end()) for m in WORD.finditer(text.translate(WORDS))]
                    kept, last = [], 0
                    for a, b in gone:
                        kept.append(text[last : at[a][0]])
                        last = at[b - 1][1]
                    text = b"".join([*kept, text[last:]])
                out.append(None if text is None else text.decode())
                gone_words.append(sum(b - a for a, b in gone))
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(gone_words, pa.int64()), pa.array(out, pa.string())], [names[0], *names[2:], "n_removed", "left"])

        return one

    found = find(docs, items, n).withColumn("contaminated", contaminated(hits("spans"), F.col("n_words"), coverage)).select(names)
    kept = [f for f in found.schema.fields if f.name != "text"]
    return found.mapInArrow(per_batch(make), StructType([*kept, StructField("n_removed", LongType()), StructField("left", StringType())]))


def clean(docs: DataFrame, items: DataFrame, n: int = N, coverage: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with docs' own columns; a text is judged on the hits of all shards."""
    found, own = matched(docs, items, n)
    bad = contaminated(hits(f"{own}.spans"), F.col(f"{own}.n_words"), coverage)
    return found.where(~bad).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, how many words ``remove`` takes out, and the hash of the words it leaves."""
    found = remove(docs, items)
    lower = F.translate(F.coalesce("left", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    left = F.sha2(F.array_join(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), " "), 256)
    return found.select("doc_id", "n_words", hits("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_removed", left.alias("left_sha256"))


def op2_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_SPLIT}, []) AS ws FROM documents),
b AS (SELECT item_id, coalesce({_SPLIT}, []) AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM b WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM sized)
), ks AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT r, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM (SELECT r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)
), met AS (SELECT r, i, g.k, item_id FROM grams g JOIN windows USING (k, w)),
pos AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM met)),
hit AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
listed AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM met WHERE item_id IS NOT NULL GROUP BY r),
runs AS (SELECT r, p, count(*) OVER (PARTITION BY r, p - n) AS size FROM (SELECT r, p, row_number() OVER (PARTITION BY r ORDER BY p) AS n FROM pos)),
gone AS (SELECT r, list(p) AS ps FROM runs JOIN hit USING (r) JOIN d USING (r) WHERE size >= 13 OR 20 * n_hit >= len(ws) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN coalesce(array_to_string(ws, ' '), '') ELSE coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(ws)), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]), ' '), '') END) AS left_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r) LEFT JOIN gone USING (r)
"""
