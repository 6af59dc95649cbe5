"""Nearest neighbours by cells: an inverted file over k-means centres, exact by bounds or approximate by probes.

Every row lies in the cell of its nearest centre; the centres alone come from a bounded sample (SAMPLE rows of smallest
hash) and are at most CENTRES, so they are small enough to broadcast, and nothing else is. Rows with one vector and one
label lie together: of them only as many as may be told are searched, by smallest id. A query asks its PROBES nearest cells
first. ``exact`` then asks each further cell whose nearest possible row (centre's distance less the cell's radius, on
unit vectors) could still come before the last row found; without it a search stops before that. How many probes reach a
wanted recall depends on the vectors (few where they cluster, most cells where they don't), so ``probes_for`` measures it on
TRIED queries against the exact search. Cells are searched by tasks of their
own: a task holds a part of a cell (PART rows) and reads the queries that ask it, so that neither a large cell nor many
queries make a large task, and no vector passes the driver but the sample.

Defined cases: null vectors have no neighbours and are none; vectors of zeros are one to all; a row is no neighbour of itself
(its id); ties go by id; fewer rows than asked for give fewer; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.vectors import MOST, matrix, thinned
from tessera.sources.published import workspace

SAMPLE, CENTRES, PART, PROBES = 20_000, 1024, 20_000, 4
#: Rows a cell: where vectors hardly cluster each query asks nearly all cells, so that few large ones send fewer queries on.
CELL = 4000
#: Queries, by smallest hash, on which recall is measured.
TRIED = 200
#: More than rounding errors of a distance.
SLACK = 1e-6


def saved(df: DataFrame, name: str) -> DataFrame:
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def centred(rows: DataFrame, cells: int | None = None, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by k-means on the sample: one for CELL rows, or as many as are asked for, CENTRES at most."""
    n = rows.where("embedding is not null").count()
    if not n:
        return np.empty((0, 1))
    k = min(cells or max(1, n // CELL), CENTRES, n)
    got = rows.where("embedding is not null").select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).collect()
    x = matrix(pa.array([list(r.embedding) for r in got], pa.list_(pa.float64())))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            members = x[own == j]
            if len(members):
                mean = members.sum(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Straight distances of normalised vectors (a vector of zeros stands a way of 1 off) to centres."""
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T))


def placed(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """rows (vec_id, embedding, label) -> cell, far (its centre's distance), part, vec_id, embedding, label: each row but those that could never be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(matrix(batch.column(1)), centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], ["vec_id", "embedding", "label", "cell", "far"])

    own = rows.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"))
    alike = Window.partitionBy("embedding", "label", "salt").orderBy("vec_id")
    # rows alike: first within parts by hash, then among what is left, so that no task ranks a hot vector alone
    for salts in (64, 1):
        own = own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("place", F.row_number().over(alike)).where(F.col("place") <= most + 1).drop("salt", "place")
    df = own.mapInArrow(run, "vec_id long, embedding array<double>, label double, cell int, far double")
    return saved(df, "cells")


def searched(most: int, furthest: float, kept: Callable | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by cell, part, asks: a part's rows are held, then each batch of queries is multiplied with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            cell, part, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            turn = np.flatnonzero(np.concatenate(([True], (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(asks.astype(int)) != 0))))
            for lo, hi in zip(turn, [*turn[1:], len(cell)], strict=True):
                some = batch.slice(lo, hi - lo)
                if now != (cell[lo], part[lo]):
                    now, held, block = (cell[lo], part[lo]), [], None
                if not asks[lo]:
                    held.append(some)
                    continue
                if not held:
                    continue
                if block is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    block = rows["vec_id"].to_numpy(), matrix(rows["embedding"].combine_chunks()), rows["label"].to_numpy()
                ids, x, labels = block
                q, ql = some.column(3).to_numpy(zero_copy_only=False), some.column(5).to_numpy(zero_copy_only=False)
                best = []
                for at in range(0, len(q), 1024):
                    s = slice(at, at + 1024)
                    d = np.round(1 - matrix(some.column(4)[s]) @ x.T, 9)
                    ok = (d <= furthest) & (q[s, None] != ids[None, :])
                    if kept is not None:
                        ok &= kept(d, ids[None, :], labels[None, :], ql[s, None])
                    d = np.where(ok, d, np.inf)
                    n = min(most, d.shape[1])
                    i, j = np.nonzero((d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]) & np.isfinite(d))
                    best.append((q[s][i], ql[s][i], ids[j], labels[j], d[i, j]))
                cols = thinned(best, most)
                yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["q", "qlabel", "id", "label", "d"])

    return run


def asked(index: DataFrame, asks: DataFrame, most: int, furthest: float, kept: Callable | None) -> DataFrame:
    """index (placed), asks (q, embedding, label, cell) -> the best of each part of a cell for each query."""
    parts = index.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).cast("int").alias("parts"))
    # one row a cell, CENTRES at most
    rows = index.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "embedding", "label")
    queries = asks.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), F.col("q").alias("vec_id"), "embedding", "label")
    dealt = rows.unionByName(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    return dealt.mapInArrow(searched(most, furthest, kept), "q long, qlabel double, id long, label double, d double")


def _best(found: DataFrame, most: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rn", rn).where(F.col("rn") <= most)


def ordered(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """q, embedding, label, ds (distances of the centres), places (each centre's place by distance)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(matrix(batch.column(1)), centres)
            order = np.argsort(d, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(d.shape[1])[None, :].repeat(len(d), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(list(place), pa.list_(pa.int32()))], ["q", "embedding", "label", "ds", "places"])

    own = queries.where("embedding is not null").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"))
    return saved(own.mapInArrow(each, "q long, embedding array<double>, label double, ds array<double>, places array<int>"), "queries")


def probes_for(rows: DataFrame, recall: float = 0.95, most: int = MOST, cells: int | None = None) -> int:
    """The fewest probes by which the tried queries find the wanted share of their nearest rows."""
    tried = rows.where("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(TRIED)
    centres = centred(rows, cells)
    index = placed(rows, centres, most)
    found = neighbours(rows, tried, most, cells=cells).select("q", "id")
    at = found.join(index.select(F.col("vec_id").alias("id"), "cell"), "id").join(ordered(tried, centres).select("q", "places"), "q")
    # a row a place, CENTRES at most
    counts = sorted((r["place"], r["count"]) for r in at.groupBy(F.expr("places[cell]").alias("place")).count().collect())
    total, seen = sum(n for _, n in counts), 0
    for place, n in counts:
        seen += n
        if seen >= recall * total:
            return place + 1
    return PROBES


def neighbours(rows: DataFrame, queries: DataFrame, most: int = MOST, furthest: float = 2.0, kept: Callable | None = None, probes: int = PROBES, exact: bool = True, cells: int | None = None) -> DataFrame:
    """rows, queries (vec_id, embedding, label) -> q, qlabel, id, label, d, rn, as ``vectors.neighbours`` gives them. kept may judge ids by label and distance alone."""
    centres = centred(rows, cells)
    index = placed(rows, centres, most)
    near = min(probes, len(centres)) if len(centres) else 0
    own = queries.where("embedding is not null").select(F.col("vec_id").alias("q"), F.col("label").cast("double").alias("label"))
    if not near:
        return own.limit(0).select("q", F.col("label").cast("int").alias("qlabel"), F.col("q").alias("id"), F.col("label").cast("int"), F.col("label").alias("d"), F.col("q").alias("rn"))
    own = ordered(queries, centres)
    wide = own.select("q", "embedding", "label", F.posexplode(F.arrays_zip("ds", "places")).alias("cell", "c")).select("q", "embedding", "label", "cell", F.col("c.ds").alias("to"), F.col("c.places").alias("place"))
    found = saved(_best(asked(index, wide.where(F.col("place") < near), most, furthest, kept), most).drop("rn"), "found")
    if exact:
        # of a query the last distance that counts: none yet if it has found too few
        last = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select(F.col("q").alias("of"), F.when(F.col("n") >= most, F.col("d")).otherwise(furthest).alias("last"))
        radius = index.groupBy("cell").agg(F.max("far").alias("radius"))
        more = own.join(last, own["q"] == last["of"], "left").withColumn("last", F.coalesce("last", F.lit(furthest))).drop("of")
        more = more.select("q", "embedding", "label", "last", F.posexplode(F.arrays_zip("ds", "places")).alias("cell", "c")).where(F.col("c.places") >= near).join(F.broadcast(radius), "cell")
        # rows within last lie within sqrt(2 * last) on unit vectors; a vector of zeros (length 0, distance 1 to all) asks all
        zero = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v) == 0
        reach = F.sqrt(2 * F.greatest(F.col("last"), F.lit(0.0))) + SLACK
        more = more.where(zero | (F.col("c.ds") - F.col("radius") <= reach) | ((F.col("last") >= 1 - SLACK) & (F.col("radius") >= 1 - SLACK))).select("q", "embedding", "label", "cell")
        found = found.unionByName(asked(index, more, most, furthest, kept))
    return _best(found, most).select("q", F.col("qlabel").cast("int").alias("qlabel"), "id", F.col("label").cast("int").alias("label"), "d", F.col("rn").cast("long").alias("rn"))
