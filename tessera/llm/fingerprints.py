"""Operator 10: SimHash document fingerprints of 256 bits, and permuted block tables to search them.

The terms of a text are its five-word shingles (fewer words: the whole sequence), lower-cased in
ASCII; a term weighs 1 + ln(its count) and votes with the bits of its hash. Fingerprints that differ in ``radius`` bits or
fewer have one of radius + 1 blocks equal: each block in turn leads a table, rows meet on its bits, and full distances
decide. ``within`` gives the pairs of a set of queries; ``near_counts`` their numbers, for which a bucket's queries are
held in blocks while its fingerprints stream by, so that no pair is written; a pair is counted in the first block in which
it agrees. Buckets of more than BUCKET fingerprints are dealt on in parts, each of which gets all the bucket's queries.

Defined cases: null text is empty; a text without words has fingerprint zero; equal texts
have equal fingerprints; in ``edited`` rows that repeat a doc_id follow each other by text (they are dealt together and
stream) and null doc_ids come last; a single document is its own next; null fingerprints match nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import column_bytes, per_batch, table, written
from tessera.llm.simhash_dedup import shingles

BITS, TERM = 256, 5
#: Rows a slice, and the most slices; beyond those slices grow.
SLICE, MOST = 1024, 40_000
#: Bits that near fingerprints may differ in, fingerprints a part of a bucket, queries held at once.
RADIUS, BUCKET, HELD = 7, 200_000, 2048
_ZERO = np.zeros(BITS // 8, np.uint8)


def fingerprint(text: bytes | None) -> np.ndarray:
    """32 bytes."""
    parts = shingles(text, TERM)
    if not parts:
        return _ZERO
    digest = xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join([digest(s, 10) + digest(s, 11) for s in parts]), np.uint8).reshape(-1, BITS // 8)
    counts = np.ones(len(raw), np.float32)
    keys = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
    unique, first, times = np.unique(keys, return_index=True, return_counts=True)
    if len(unique) < len(keys):
        raw, counts = raw[first], 1 + np.log(times).astype(np.float32)
        votes = counts @ np.unpackbits(raw, axis=1).astype(np.float32)
        return np.packbits(2 * votes > counts.sum())
    return np.packbits(2 * np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64) > len(raw))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (hex)."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t).tobytes().hex() for t in column_bytes(batch, "text")], pa.string())], ["doc_id", "fingerprint"])

        return one

    return source.mapInArrow(per_batch(make), f"doc_id {dict(source.dtypes)['doc_id']}, fingerprint string")


def block_bytes(radius: int) -> list[tuple[int, int]]:
    """Whole bytes of the fingerprint, as (first, end), for radius + 1 blocks."""
    size = BITS // 8
    at = [round(k * size / (radius + 1)) for k in range(radius + 2)]
    if radius + 1 > size:
        raise ValueError(f"a radius of {size - 1} at most")
    return list(zip(at, at[1:], strict=False))


def _tables(df: DataFrame, radius: int, *keep: str) -> DataFrame:
    """A row for each fingerprint (bytes in column fp) and block: block, key (hash of its bits), fp, the columns to keep."""
    bits = F.array(*(F.substring("fp", a + 1, b - a) for a, b in block_bytes(radius)))
    return df.select("fp", *keep, F.posexplode(bits).alias("block", "bits")).select("block", F.xxhash64("block", "bits").alias("key"), "fp", *keep)


def _distinct(prints: DataFrame, name: str) -> DataFrame:
    return prints.where("fingerprint is not null").select(F.unhex("fingerprint").alias("fp")).distinct().withColumn(name, F.lit(True))


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of distinct fingerprints (query, found, distance) no more than radius bits apart, equal ones included; prints and queries have a column fingerprint.

    Copies are not expanded: join the result back by fingerprint for documents.
    """
    out = "query string, found string, distance long"
    return _met(prints, queries, radius, lambda q, f, d: [(a.tobytes().hex(), b.tobytes().hex(), int(n)) for a, b, n in zip(q, f, d, strict=True)], out)


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint of each distinct query that has any, near: how many other distinct fingerprints are no more than radius bits apart."""

    def counted(q: np.ndarray, f: np.ndarray, d: np.ndarray) -> list[tuple]:
        other = d > 0
        which, n = np.unique(q[other], axis=0, return_counts=True)
        return [(w.tobytes().hex(), int(k)) for w, k in zip(which, n, strict=True)]

    found = _met(prints, queries, radius, counted, "query string, n long")
    return found.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("near"))


def _met(prints: DataFrame, queries: DataFrame, radius: int, rows_of, schema: str) -> DataFrame:
    """rows_of(queries, found, distances) of the pairs of each bucket that agree in no earlier block."""
    both = _distinct(prints, "found").unionByName(_distinct(queries, "query"), allowMissingColumns=True)
    sides = both.groupBy("fp").agg(F.coalesce(F.max("found"), F.lit(False)).alias("found"), F.coalesce(F.max("query"), F.lit(False)).alias("query"))
    sides, _ = written(sides, "fingerprints")
    dealt = _tables(sides, radius, "found", "query")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("asked")).where((F.col("asked") > 0) & (F.col("n") > BUCKET))
    hot, _ = written(sizes.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"), F.ceil(F.col("asked") / BUCKET).cast("int").alias("slices")), "hot")
    if hot.head(1):  # fingerprints go to their part of each slice of the queries, queries to their slice of each part
        met = dealt.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("slices", F.coalesce("slices", F.lit(1)))
        of = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
        part, slice_ = of("parts", 0), of("slices", 1)
        asked = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct((p * F.col("slices") + slice_).alias("part"), F.lit(True).alias("query")))
        told = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda q: F.struct((part * F.col("slices") + q).alias("part"), F.lit(False).alias("query")))
        none = F.array().cast("array<struct<part:int,query:boolean>>")
        to = F.explode(F.concat(F.when(F.col("query"), asked).otherwise(none), F.when(F.col("found"), told).otherwise(none)))
        dealt = met.select("block", "key", "fp", to.alias("to")).select("block", "key", "to.part", "to.query", "fp", (~F.col("to.query")).alias("found"))
    else:
        dealt = dealt.select("block", "key", F.lit(0).alias("part"), "query", "fp", "found")
    blocks = block_bytes(radius)
    names = [c.split()[0] for c in schema.split(", ")]
    words = BITS // 64

    def pairs(asked: np.ndarray, found: np.ndarray, block: int) -> list[tuple]:
        out = []
        for at in range(0, len(asked), HELD):
            for start in range(0, len(found), 256):
                q, f = asked[at : at + HELD], found[start : start + 256]
                apart = np.bitwise_count(q[:, None, :] ^ f[None, :, :]).sum(axis=2, dtype=np.int32)
                i, j = np.nonzero(apart <= radius)
                a, b = q[i].view(np.uint8).reshape(-1, BITS // 8), f[j].view(np.uint8).reshape(-1, BITS // 8)
                x, y = blocks[block]
                new = (a[:, x:y] == b[:, x:y]).all(axis=1)
                for x, y in blocks[:block]:
                    new &= (a[:, x:y] != b[:, x:y]).any(axis=1)
                if new.any():
                    out += rows_of(a[new], b[new], apart[i, j][new])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        asked: list[np.ndarray] = []
        early: list[np.ndarray] = []  # queries that are fingerprints too wait for all queries of the bucket
        every = np.empty((0, words), np.uint64)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

        for batch in batches:
            block, key, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            query, found = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (3, 5))
            fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, words)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            ends = np.concatenate((starts[1:], [len(key)]))
            has = np.logical_or.reduceat(query, starts)
            has[0] |= now is not None and now[1:] == (key[0], part[0])
            out: list[tuple] = []
            for a, b in zip(starts[has].tolist(), ends[has].tolist(), strict=True):
                if now is None or now[1:] != (key[a], part[a]):
                    if early:
                        out += pairs(np.concatenate(asked), np.concatenate(early), now[0])
                    now, asked, early = (int(block[a]), key[a], part[a]), [], []
                n = a + int(query[a:b].sum())
                if n > a:
                    asked.append(fps[a:n])
                    early.append(fps[a:n][found[a:n]])
                if n < b:
                    if early:
                        every = np.concatenate(asked)
                        out += pairs(every, np.concatenate(early), now[0])
                        early = []
                    out += pairs(every, fps[n:b], now[0])
            if out:
                yield batch_of(out)
        if early and (out := pairs(np.concatenate(asked), np.concatenate(early), now[0])):
            yield batch_of(out)

    rows = dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.col("query").desc(), "block")
    return rows.mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _slices(docs: DataFrame) -> list:
    """Ids that cut the table into slices of about SLICE rows (more beyond MOST slices), ascending, the largest id last."""
    n = docs.count()
    cuts = min(MOST, max(1, n // SLICE))
    got = docs.agg(F.percentile_approx("doc_id", [(k + 1) / cuts for k in range(cuts)], 20 * max(cuts, 50)).alias("p"), F.max("doc_id").alias("m")).first()
    return sorted({*(got.p or ()), got.m} - {None})


def edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The next document (descending doc_id) stands in the same slice of ids, to which the first row of the slice below is
    added; rows are sorted within slices and read once.
    """
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = _slices(docs.select("doc_id"))
    if not cuts:
        cuts = [0]
    kind = dict(source.dtypes)["doc_id"]
    # the number of cuts below an id, in two steps: groups of cuts, then cuts of a group
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    id_ = F.col("doc_id")
    highest = F.array(*(F.lit(g[-1]) for g in groups)).cast(f"array<{kind}>")
    group = F.size(F.filter(highest, lambda b: b < id_))
    bounds = F.try_element_at(F.array(*(F.array(*(F.lit(c) for c in g)).cast(f"array<{kind}>") for g in groups)), group + 1)
    own = F.when(id_.isNull(), 0).otherwise(group * wide + F.coalesce(F.size(F.filter(bounds, lambda b: b < id_)), F.lit(0)))
    beyond = F.when(id_ == F.lit(cuts[-1]), F.lit(0)).when(F.array_contains(bounds, id_), own + 1)
    places = F.array(F.struct(own.alias("slice"), F.lit(False).alias("copy")), F.struct(beyond.alias("slice"), F.lit(True).alias("copy")))
    placed = source.withColumn("place", F.explode(F.filter(places, lambda p: p["slice"].isNotNull()))).select("place.slice", "place.copy", "doc_id", "text")
    dealt = placed.repartition("slice").sortWithinPartitions("slice", "copy", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        first: tuple | None = None  # the first row, for a table of null ids, whose next no slice brings
        kind_ = None

        def pair(a: tuple, b: tuple) -> tuple:
            new = edited_text(a[2], b[2])
            raw = new.encode()
            print_ = fingerprint(raw)
            return a[1], len(a[2]), hashlib.sha256(raw).hexdigest(), a[3].tobytes().hex(), print_.tobytes().hex(), likeness(a[3], print_), likeness(a[3], b[3])

        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = (kind_, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            kind_, out = batch.schema.field(2).type, []
            for slice_, copy, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copy and (held is None or held[0] != slice_):
                    continue
                row = (slice_, doc, text, fingerprint(text.encode()))
                if held is not None and held[0] == slice_:
                    out.append(pair(held, row))
                first = first or row
                held = None if copy else row
            if out:
                yield rows(out)
        if held is not None:
            yield rows([pair(held, first)])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def searched(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """``edited`` with n_near: of the documents whose id is divisible by ``every`` how many other distinct fingerprints lie within the radius, else null."""
    found, _ = written(edited(docs), "edited")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = near_counts(found.select("fingerprint"), found.where(asks).select("fingerprint"), radius)
    asked = found.where(asks).join(counts, "fingerprint", "left").withColumn("n_near", F.coalesce("near", F.lit(0).cast("long")))
    return asked.select(*found.columns, "n_near").unionByName(found.where(~asks).withColumn("n_near", F.lit(None).cast("long")))


def op10_simhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "documents"))
