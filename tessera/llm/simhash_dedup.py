"""Operator 4: near duplicates by SimHash, with pivot distance tables for the pairs.

Of each fingerprint the Hamming distances to PIVOTS reference fingerprints are kept, split by
BLOCKS blocks of bits (a distance is the sum of its parts). Two fingerprints that differ in ``radius`` bits or
fewer differ in no coordinate by more than ``radius``, and as at least BLOCKS - radius
blocks hold no difference, all coordinates of those blocks agree: their parts of the table are the
keys that deal fingerprints into buckets. Within a bucket pairs whose coordinates differ by more than the
radius are discarded, and the rest verified by Hamming distance.

Only distinct fingerprints are compared. A bucket yields the edges of a spanning forest, not its pairs;
buckets of more than LIMIT fingerprints are dealt anew by 13 of 16 blocks of four bits, into
buckets that cannot hold more than 4096 (2 ** 12). Components follow from the edges.

Defined cases: null text is empty; a text without words has fingerprint zero and is linked like
any other; equal fingerprints are one component; rows may repeat; a component of null doc_ids only has
component_id null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import LOWER, column_bytes, per_batch, table, written
from tessera.llm.graph import components

RADIUS = 3
BLOCKS = 6
PIVOTS = 16
LIMIT = 4096
COMMON = 10_000
_ROOT = np.random.default_rng(4)
REFERENCE = _ROOT.integers(0, 1 << 64, PIVOTS, np.uint64)
WEIGHT = _ROOT.integers(0, 1 << 63, (BLOCKS, PIVOTS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, k: int = 3) -> list[bytes]:
    """Space-joined runs of k words; the whole sequence if there are fewer."""
    words = text.translate(LOWER).split() if text else []
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-k]))
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes | None) -> int:
    digest = xxhash.xxh64_intdigest
    if not (parts := shingles(text)):
        return 0
    bits = np.unpackbits(np.array([digest(s, 42) for s in parts], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(parts)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the columns to keep, fp (64 bits as a signed long)."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    kinds = dict(source.dtypes)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([fingerprint(t) for t in column_bytes(batch, "text")], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(got.view(np.int64))], ["doc_id", *keep, "fp"])

        return one

    return source.mapInArrow(per_batch(make), ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *keep)] + ["fp long"]))


def block_masks(blocks: int, bits: int = 64) -> list[np.uint64]:
    at = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(at, at[1:], strict=False)]


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Fingerprints x blocks x pivots: the parts of the Hamming distances."""
    return np.stack([np.bitwise_count((fps[:, None] ^ REFERENCE[None, :]) & m) for m in block_masks(BLOCKS)], axis=1)


def salt(t: int) -> np.uint64:
    return np.uint64((t + 1) * 0xD1B54A32D192ED03 % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def keys(fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """For each choice of blocks that may hold no difference: the key of their coordinates."""
    parts = (distance_table(fps).astype(np.uint64) * WEIGHT).sum(axis=2, dtype=np.uint64)
    for t, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        yield mixed(parts[:, list(blocks)].sum(axis=1, dtype=np.uint64) + salt(t))


def finer_keys(key: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """16 blocks of 4 bits; 13 of them hold no difference: at most 12 bits, LIMIT fingerprints, are free."""
    masks = block_masks(16)
    for t, free in enumerate(combinations(range(16), radius)):
        away = np.uint64(0)
        for b in free:
            away |= masks[b]
        yield mixed(mixed(fps & ~away) ^ key ^ salt(t))


def links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the distinct fingerprints of one bucket."""
    coordinates = distance_table(fps).sum(axis=1, dtype=np.int16)
    order = np.argsort(coordinates[:, 0], kind="stable")
    fps, coordinates = fps[order], coordinates[order]
    first = coordinates[:, 0].copy()
    free = np.ones(len(fps), bool)
    for seed in range(len(fps)):
        if not free[seed]:
            continue
        free[seed] = False
        todo = [seed]
        while todo:
            x = todo.pop()
            a, b = np.searchsorted(first, (first[x] - radius, first[x] + radius + 1))
            near = a + np.flatnonzero(free[a:b])
            near = near[np.abs(coordinates[near] - coordinates[x]).max(axis=1, initial=0) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if len(near):
                free[near] = False
                todo.extend(near.tolist())
                yield np.full(len(near), fps[x]), fps[near]


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of many small buckets at once."""
    for size in np.unique(sizes).tolist():
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        left, right = fps[(at + i).ravel()], fps[(at + j).ravel()]
        apart = np.zeros(len(left), bool)
        for pivot in REFERENCE:
            apart |= np.abs(np.bitwise_count(left ^ pivot).astype(np.int16) - np.bitwise_count(right ^ pivot)) > radius
        near = ~apart
        near[near] = np.bitwise_count(left[near] ^ right[near]) <= radius
        yield left[near], right[near]


def bucket_edges(radius: int, limit: int | None):
    """Over rows sorted by key: edges (a, b); members of a bucket over the limit come back as (key, fp) with over = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.uint64), np.empty(0, np.uint64)
        over: np.uint64 | None = None

        def out(a: list[np.ndarray], b: list[np.ndarray], flag: bool) -> pa.RecordBatch:
            x, y = (np.concatenate([*v, np.empty(0, np.uint64)]).view(np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), flag))], ["a", "b", "over"])

        def solved(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            a, b = [], []
            small = (sizes > 1) & (sizes <= 8)
            for x, y in small_links(f, starts[small], sizes[small], radius):
                a.append(x)
                b.append(y)
            for at, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                if limit is not None and size > limit:
                    yield out([k[at : at + size]], [f[at : at + size]], True)
                    continue
                for x, y in links(f[at : at + size], radius):
                    a.append(x)
                    b.append(y)
            yield out(a, b, False)

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if over is not None:  # the rest of a bucket that was too large
                n = int(np.argmax(k != over)) if (k != over).any() else len(k)
                if n:
                    yield out([k[:n]], [f[:n]], True)
                k, f = k[n:], f[n:]
                if len(k):
                    over = None
            if not len(k):
                continue
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
            last = len(k) - int(np.argmax(k[::-1] != k[-1])) if (k != k[-1]).any() else 0
            yield from solved(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if limit is not None and len(held_k) > limit:
                over = held_k[0]
                yield out([held_k], [held_f], True)
                held_k, held_f = held_k[:0], held_f[:0]
        yield from solved(held_k, held_f)

    return run


def edges(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """distinct (fp) -> edges (a, b) that connect whatever is linked."""

    def dealt(finer: bool):
        def make():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                cols = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(batch.num_columns)]
                ks = list(finer_keys(*cols, radius) if finer else keys(cols[0], radius))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.tile(cols[-1], len(ks)).view(np.int64))], ["key", "fp"])

            return one

        return per_batch(make)

    def step(rows: DataFrame, finer: bool) -> DataFrame:
        buckets = rows.mapInArrow(dealt(finer), "key long, fp long").repartition("key").sortWithinPartitions("key")
        return buckets.mapInArrow(bucket_edges(radius, None if finer else limit), "a long, b long, over boolean")

    found, _ = written(step(distinct, False), "links")
    pairs = found.where("not over").select("a", "b")
    if found.where("over").head(1):
        rest, _ = written(step(found.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct(), True), "links")
        pairs = pairs.unionByName(rest.select("a", "b"))
    return pairs


def rooted(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """prints (doc_id, fp) -> fp, least (smallest doc_id with it), n (rows with it), root of its component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(edges(distinct.select("fp"), radius, limit))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def firsts(docs: DataFrame) -> DataFrame:
    """One row of each component: the smallest doc_id's (null last), then by hash of the text, then by the other columns as JSON."""
    hashed = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in ("doc_id", "text")]
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = "__key" + "_" * max(map(len, docs.columns))  # longer than any other name
    keyed = docs.withColumn(key, F.concat(*hashed))
    prints, _ = written(fingerprints(keyed, key), "fingerprints")
    rows = prints.groupBy(key, "fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key, "n")).alias("least"))  # one row a fingerprint meets its root
    of_root = first.join(rooted(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min("least").alias("least"))
    stay, _ = written(of_root.select(f"least.{key}", "least.n"), "stay")
    once = keyed.join(stay.where("n = 1"), key, "left_semi").select(*own)
    if not stay.where("n > 1").head(1):
        return once
    again = keyed.join(stay.where("n > 1"), key, "left_semi")
    row = F.min_by(F.struct(*own), F.to_json(F.struct(*own))).alias("row")
    return once.unionByName(again.groupBy(key).agg(row).select("row.*"))


def classes(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id (smallest doc_id reachable).

    Fingerprints of many rows, at most COMMON by their least number of rows, are broadcast, so that their rows aren't dealt by them.
    """
    prints, _ = written(fingerprints(docs), "fingerprints")
    of = rooted(prints, radius, limit)
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known, _ = written(of.join(named, "root").select("fp", "component_id", "n"), "classes")
    often = F.col("n") > max(1000, prints.count() // COMMON)
    common = F.broadcast(known.where(often).drop("n"))
    rare = prints.join(common.select("fp"), "fp", "left_anti").join(known.where(~often).drop("n"), "fp")
    return prints.join(common, "fp").unionByName(rare).select("doc_id", "fp", "component_id")


def op4_pivot_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
