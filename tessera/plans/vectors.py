"""Vector retrieval, feedback votes and rank fusion, over the embeddings table.

Queries are a stated set (every row whose id is divisible by EVERY) against all rows, in blocks: a block of QUERIES vectors
at most is held by each task, which reads its rows once, multiplies, and keeps of each query its nearest; the tasks'
nearest are ranked by windows. No pair is written that is not among a task's nearest. Distances are 1 - cosine, rounded to nine places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import DUCK, SPARK

EVERY, QUERIES_AT_ONCE, MOST = 20, 20_000, 15
#: Rows and queries that are multiplied at once, and pairs that a task holds beside its nearest: its memory, whatever the batches and the table.
ROWS, COLUMNS, PAIRS = 2048, 512, 250_000
#: Nearest that a task holds at most: so many queries fewer where more of each are told.
HELD = 300_000
PLANS: dict[str, Callable] = {}
ORACLES: dict[str, Callable] = {}
QUERIES: dict[str, Callable] = {}


def matrix(column: pa.Array) -> np.ndarray:
    """Normalised rows; a vector of zeros stays one."""
    x = np.array(column.to_pylist(), np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.empty((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def neighbours(rows: DataFrame, queries: DataFrame, most: int = MOST, furthest: float = 2.0, kept: Callable | None = None) -> DataFrame:
    """rows, queries (vec_id, embedding, label) -> q, qlabel, id, label, d, rn: of each query its ``most`` nearest other rows no further than ``furthest``.

    kept(d, id, label, qlabel) -> which pairs count, as arrays that broadcast over queries x rows. Null vectors have no neighbours; ties go by id.
    """
    spark = rows.sparkSession
    own = queries.where("embedding is not null").select("vec_id", "embedding", "label")
    blocks = max(1, -(-own.count() // min(QUERIES_AT_ONCE, max(1, HELD // most))))
    found = None
    for k in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)
        got = sorted(((r.vec_id, r.label, list(r.embedding)) for r in block.collect()), key=lambda r: r[0])
        ids = np.array([r[0] for r in got], np.int64)
        labels = np.array([np.nan if r[1] is None else r[1] for r in got], np.float64)
        held = spark.sparkContext.broadcast((ids, labels, matrix(pa.array([r[2] for r in got], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, ql, qm = held.value
            if not len(q):
                return
            best: list[tuple] = []
            held_pairs, furthest_kept = 0, np.full(len(q), np.inf)
            for part in parts_of(batches):
                id_, x = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column(1))
                label = part.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
                for at in range(0, len(q), COLUMNS):
                    some = slice(at, at + COLUMNS)
                    d = np.round(1 - qm[some] @ x.T, 9)
                    ok = (d <= np.minimum(furthest, furthest_kept[some, None])) & (q[some, None] != id_[None, :])
                    if kept is not None:
                        ok &= kept(d, id_[None, :], label[None, :], ql[some, None])
                    if not ok.any():
                        continue
                    d = np.where(ok, d, np.inf)
                    n = min(most, d.shape[1])
                    if ok.sum() > n * len(d):
                        ok &= d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]  # ties with the last one too
                    i, j = np.nonzero(ok)
                    best.append((q[some][i], ql[some][i], id_[j], label[j], d[i, j]))
                    held_pairs += len(i)
                    if held_pairs > PAIRS:
                        best = [thinned(best, most)]
                        held_pairs = 0
                        furthest_kept = last_kept(q, best[0], most)
            if best:
                cols = thinned(best, most)
                arrays = [pa.array(c, t, from_pandas=True) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["q", "qlabel", "id", "label", "d"])

        part = rows.select("vec_id", "embedding", "label").mapInArrow(run, "q long, qlabel double, id long, label double, d double")
        found = part if found is None else found.unionByName(part)
    rn = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rn", rn).where(F.col("rn") <= most).select("q", F.col("qlabel").cast("int").alias("qlabel"), "id", F.col("label").cast("int").alias("label"), "d", F.col("rn").cast("long").alias("rn"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose vector isn't null, ROWS at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            part = part.filter(part.column(1).is_valid())
            if part.num_rows:
                yield part


def last_kept(q: np.ndarray, best: tuple, most: int) -> np.ndarray:
    """Of each query how far the last of its ``most`` nearest is; what is further can't be told any more. Without so many: no bound."""
    first, last = np.searchsorted(best[0], q, "left"), np.searchsorted(best[0], q, "right") - 1
    full = last - first + 1 >= most
    return np.where(full, best[4][np.where(full, last, 0)], np.inf) if len(best[0]) else np.full(len(q), np.inf)


def thinned(parts: list[tuple], most: int) -> tuple:
    """Of each query the nearest ``most`` of several parts, ties with the last one by id."""
    q, ql, id_, label, d = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((id_, d, q))
    q, ql, id_, label, d = q[order], ql[order], id_[order], label[order], d[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
    keep = place < most
    return q[keep], ql[keep], id_[keep], label[keep], d[keep]


def _table(spark: SparkSession, sf_dir: str, most: int = MOST, furthest: float = 2.0, kept: Callable | None = None, which: str = f"vec_id % {EVERY} = 0") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, rows.where(which), most, furthest, kept)


def pairs(policy: str = "d <= 2", which: str = f"vec_id % {EVERY} = 0") -> str:
    """The same by DuckDB, over all pairs."""
    return f"""(SELECT q, id, qlabel, label, d, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rn FROM (SELECT a.vec_id AS q, a.label AS qlabel, b.vec_id AS id, b.label, round({DUCK.cosine('a.embedding', 'b.embedding')}, 9) AS d
      FROM (SELECT * FROM embeddings WHERE {which}) a JOIN embeddings b ON a.vec_id <> b.vec_id) p WHERE {policy})"""


def planned(nearest: Callable[[SparkSession, str], DataFrame], oracle_pairs: str):
    """A query over nearest neighbours: the rest of the text is one for both engines, given a dialect and the neighbours' table."""

    def wrap(text: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            nearest(spark, sf_dir).createOrReplaceTempView("nearest_rows")
            for t in ("documents", "embeddings"):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            return spark.sql(text(SPARK, "nearest_rows"))

        run.__doc__ = text.__doc__
        PLANS[text.__name__] = run
        ORACLES[text.__name__] = lambda _: text(DUCK, oracle_pairs)
        return text

    return wrap


@planned(lambda s, p: _table(s, p, 5, 0.75), pairs("d >= 0 AND d <= 0.75"))
def semantic_topk(d, near):
    """The nearest five within the cutoff, finite distances only."""
    return f"SELECT q, id, round(d, 6) AS distance, CAST(rn AS BIGINT) AS rn FROM {near} r WHERE rn <= 5"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    current = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id").distinct()
    valid = rows.where("label is not null").join(current, F.col("vec_id") == F.col("doc_id"), "left_semi")
    return neighbours(valid, rows.where(f"vec_id % {EVERY} = 0"), 3)


@planned(_judged, pairs("label IS NOT NULL AND id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"))
def j2_knn_valid(d, near):
    """Neighbours that have a label, and whose document's own judgement stands in the labels."""
    return f"SELECT q, id, label FROM {near} r WHERE rn <= 3"


def votes(near) -> str:
    return f"(SELECT q, qlabel, label, CAST(sum(CAST(round((1 - d) * 1000000) AS BIGINT)) AS BIGINT) AS w, count(*) AS n FROM {near} r WHERE rn <= 15 GROUP BY q, qlabel, label)"


def vote(near) -> str:
    return f"""SELECT q, CASE WHEN n >= 2 AND share >= 0.2 AND w - runner >= 1 THEN label END AS vote, n AS support, round(share, 6) AS share FROM
      (SELECT q, label, n, w, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY q) AS share, coalesce(lead(w) OVER (PARTITION BY q ORDER BY w DESC, label), 0) AS runner, row_number() OVER (PARTITION BY q ORDER BY w DESC, label) AS place FROM {votes(near)} v) x WHERE place = 1"""


@planned(_table, pairs())
def knn_vote(d, near):
    """Weights 1 - d, support and share thresholds, ties by label; abstains below them."""
    return vote(near)


@planned(lambda s, p: _table(s, p, 1, 0.80, lambda d, i, label, ql: (d <= 0.70) | (label == ql)), pairs("d <= 0.70 OR (label = qlabel AND d <= 0.80)"))
def correction_match(d, near):
    """Near, or of the same sender and not too far."""
    return f"SELECT q, id FROM {near} r WHERE rn = 1"


@planned(lambda s, p: _table(s, p, 3, 0.78), pairs("d <= 0.78"))
def precedent_gate(d, near):
    """The nearest three, if there are three."""
    return f"SELECT q, count(DISTINCT id) >= 3 AS gated, {d.listed('CAST(id AS STRING)')} AS ids FROM {near} r WHERE rn <= 3 GROUP BY q"


def _by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans import cells

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cells.neighbours(rows, rows)


@planned(_by_cells, pairs(which="true"))
def j8_all_neighbours(d, near):
    """Of every row the nearest fifteen, exactly, by cells."""
    return f"SELECT q, id, CAST(rn AS BIGINT) AS rn FROM {near} r WHERE rn <= 15"


@planned(_table, pairs())
def policy_grid_best(d, near):
    """The policy with the most right votes, then the larger coverage, then the smaller distance."""
    return f"""SELECT CAST(maxd AS DOUBLE) AS maxd, k, hits, covered FROM (SELECT maxd, k, CAST(count_if(vote = qlabel) AS BIGINT) AS hits, count(vote) AS covered FROM
      (SELECT maxd, k, q, qlabel, {d.argmax('label', 'n * 1000 - label')} AS vote FROM (SELECT g.maxd, h.k, r.q, r.qlabel, r.label, count(*) AS n FROM {near} r JOIN (VALUES (0.7), (0.8), (0.9)) AS g(maxd) ON r.d <= g.maxd JOIN (VALUES (5), (15)) AS h(k) ON r.rn <= h.k
      GROUP BY g.maxd, h.k, r.q, r.qlabel, r.label) c GROUP BY maxd, k, q, qlabel) s GROUP BY maxd, k) t ORDER BY hits DESC, covered DESC, maxd, k LIMIT 1"""


@planned(lambda s, p: _table(s, p, 100), pairs())
def hybrid_rank(d, near):
    """reciprocal ranks of both sides, fused, for every query: fifty lexical rows (each query's own word) and a hundred semantic ones; ties by lexical rank, semantic rank, id; twenty a query."""
    word = "CASE q % 3 WHEN 0 THEN 'that' WHEN 1 THEN 'the' ELSE 'und' END"
    lexical = f"(SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id DESC) AS lex FROM documents JOIN (VALUES ('that'), ('the'), ('und')) AS w(word) ON {d.has('lower(text)', 'w.word')})"
    left = f"(SELECT q, doc_id AS id, lex FROM (SELECT DISTINCT q, {word} AS word FROM {near} r) a JOIN {lexical} b ON b.word = a.word AND b.lex <= 50)"
    fused = f"""(SELECT coalesce(l.q, s.q) AS q, coalesce(l.id, s.id) AS id, l.lex, s.rn AS sem, coalesce(CAST(2 AS DOUBLE) / (20 + l.lex), 0) + coalesce(greatest(CAST(0 AS DOUBLE), 1 - s.d) / (20 + s.rn), 0) AS score
      FROM {left} l FULL OUTER JOIN (SELECT q, id, d, rn FROM {near} n WHERE rn <= 100) s ON s.id = l.id AND s.q = l.q)"""
    return f"SELECT q, id, score, place FROM (SELECT q, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, lex NULLS LAST, sem NULLS LAST, id) AS BIGINT) AS place FROM {fused} f) p WHERE place <= 20"


@planned(_table, pairs())
def o1_local_inference(d, near):
    """O1: the vote of the neighbours, or the commonest label where they abstain."""
    return f"SELECT v.q, coalesce(v.vote, p.label) AS label, v.vote IS NULL AS fell_back FROM ({vote(near)}) v CROSS JOIN (SELECT label FROM embeddings WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) p"


def a20_vector_upsert(d):
    """Keyed by hash, the latest stands; keys whose latest is a removal go."""
    key = d.sha("concat('mail', chr(31), CAST(vec_id % 400 AS STRING))")
    return f"SELECT vector_key, vec_id, versions FROM (SELECT {key} AS vector_key, max(vec_id) AS vec_id, count(*) AS versions FROM embeddings GROUP BY 1) x WHERE vec_id % 10 <> 7"


QUERIES["a20_vector_upsert"] = a20_vector_upsert
