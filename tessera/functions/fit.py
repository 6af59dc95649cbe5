"""Risk weights fitted in the cluster: logistic regression with weights of zero or more, the whole model and one without each group.

A message's findings are one number (a bit a signal), messages alike are counted, and that table stays where it is: each
round is one job over it, in which every task adds up, for all models and step lengths together, the loss, its gradient and its
second derivatives (SIGNALS + 1 squared numbers a model); the tasks' sums are added in a shuffle. The driver holds those sums and the weights
alone, however many rows there are, and takes a projected Newton step: weights that stand at zero and are pushed against it
rest, the others move, and of the step lengths the one of least loss is taken. A model is done when no weight off its bound
has a gradient left.

Defined cases: rows without a label are left out; a message without findings counts for the bias; a signal that never fires
keeps weight 0; a table without rows, or of one label alone, gives weights 0 and bias 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.plans import signals
from tessera.plans.dialect import DUCK, SPARK, views
from tessera.plans.messages import CASES
from tessera.sources.published import workspace

SIGNALS = tuple(fixed.WEIGHTS)
#: Steps that a round tries.
LENGTHS = (1.0, 0.5, 0.25, 0.0625, 0.015625)
ROUNDS, CLOSE = 60, 1e-9


def sums(points: np.ndarray, n_signals: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over (mask, y, n): of each point (model, weights ..., bias) one row: loss, gradient, second derivatives, summed over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = n_signals + 1
        out = np.zeros((len(points), 1 + width + width * width))
        for batch in batches:
            mask, y, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = np.concatenate([(mask[:, None] >> np.arange(n_signals)) & 1, np.ones((len(mask), 1), np.int64)], axis=1).astype(float)
            for k, w in enumerate(points):
                z = x @ w
                p = 1 / (1 + np.exp(-z))
                out[k, 0] += (n * (np.logaddexp(0, z) - y * z)).sum()
                out[k, 1 : 1 + width] += x.T @ (n * (p - y))
                out[k, 1 + width :] += (x.T @ (x * (n * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["point", "s"])

    return run


def evaluated(rows: DataFrame, points: np.ndarray, n_signals: int) -> np.ndarray:
    """One row a point: the sums over the whole table, added place by place in the cluster."""
    parts = rows.mapInArrow(sums(points, n_signals), "point int, s array<double>").select("point", F.posexplode("s").alias("at", "v"))
    added = parts.groupBy("point", "at").agg(F.sum("v").alias("v")).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
    return np.array([[e.v for e in r.s] for r in sorted(added.collect(), key=lambda r: r.point)])


def fitted(rows: DataFrame, names: Sequence[str], models: Mapping[str, Iterable[str]], penalty: float = fixed.PENALTY) -> dict[str, tuple[dict[str, float], float, float]]:
    """rows (mask: bit k for names[k], y: 0 or 1, n) -> of each model (the names it goes without) weights, bias, and how far the gradient is from rest."""
    k, width = len(names), len(names) + 1
    total, ones = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0))).first()
    allowed = {m: np.array([n not in set(without) for n in names] + [True]) for m, without in models.items()}
    at = {m: np.zeros(width) for m in models}
    off = dict.fromkeys(models, 0.0)
    pull = np.array([penalty] * k + [0.0])
    trial = {m: [w] for m, w in at.items()} if 0 < ones < total else {}
    best = dict.fromkeys(models, np.inf)
    for _ in range(ROUNDS):
        if not trial:
            break
        order = [(m, w) for m, ws in trial.items() for w in ws]
        got = evaluated(rows, np.array([w for _, w in order]), k) / total
        trial, seen = {}, set()
        losses = [s[0] + (pull * w * w).sum() / 2 for (_, w), s in zip(order, got, strict=True)]
        for i in sorted(range(len(order)), key=lambda i: losses[i]):
            m, w = order[i]
            if m in seen:
                continue
            seen.add(m)
            if losses[i] > best[m]:
                continue  # no step of this round is better: the last place stands
            at[m], best[m] = w, losses[i]
            g = got[i, 1 : 1 + width] + pull * w
            moves = allowed[m] & ((np.arange(width) == k) | (w > 0) | (g < 0))
            rest = np.where(np.arange(width) == k, g, w - np.maximum(0, w - g)) * allowed[m]
            off[m] = float(np.abs(rest).max())
            if off[m] <= CLOSE:
                continue
            curve = got[i, 1 + width :].reshape(width, width) + np.diag(pull)
            step = np.zeros(width)
            step[moves] = -np.linalg.solve(curve[np.ix_(moves, moves)] + 1e-12 * np.eye(moves.sum()), g[moves])
            ahead = [w + t * step for t in LENGTHS]
            trial[m] = [np.append(np.maximum(0, a[:k]), a[k]) for a in ahead]
    return {m: (dict(zip(names, map(float, w[:k]), strict=True)), float(w[k]), off[m]) for m, w in at.items()}


#: The turns of messages that are made to deceive.
DECEIVING = (1, 3, 7, 9, 10, 14, 16, 20)


def cases(d) -> str:
    """mask, y, n: the findings of labelled messages; those of a deceiving turn, or whose text is labelled toxic, are to be caught."""
    bits = " ".join(f"WHEN '{s}' THEN {1 << k}" for k, s in enumerate(SIGNALS))
    y = f"CASE WHEN l.toxic = 1 OR l.doc_id % {len(CASES)} IN ({', '.join(map(str, DECEIVING))}) THEN 1 ELSE 0 END"
    found = f"(SELECT id, CAST(sum(CASE signal {bits} ELSE 0 END) AS BIGINT) AS mask FROM {signals.findings(d)} f GROUP BY id)"
    return f"SELECT coalesce(f.mask, 0) AS mask, CAST({y} AS BIGINT) AS y, count(*) AS n FROM labels l LEFT JOIN {found} f ON f.id = l.doc_id WHERE l.doc_id IS NOT NULL AND l.toxic IS NOT NULL GROUP BY 1, 2"


MODELS = {"none": ()} | {g: tuple(s.split()) for g, s in fixed.GROUPS.items()} | {"all but authentication": tuple(s for s in SIGNALS if not s.startswith("auth_"))}


def l7_fit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the findings, and again without each group; four places, as they are published."""
    sql = cases(SPARK)
    views(spark, sf_dir, sql)
    path = workspace(spark, "cases")
    spark.sql(sql).write.parquet(path)
    rows = spark.read.parquet(path)
    out = []
    for without, (weights, bias, _) in fitted(rows, SIGNALS, MODELS).items():
        out += [(without, s, round(w, 4) + 0.0) for s, w in (*weights.items(), ("bias", bias))]
    return spark.createDataFrame(out, "without string, signal string, weight double")


def _plain_fit(d) -> str:
    """The same by steps of accelerated projected gradient, one row of weights a model and step."""
    width, steps = len(SIGNALS) + 1, 1500
    models = ", ".join(f"('{m}', [{', '.join('0' if s in without else '1' for s in SIGNALS)}, 1])" for m, without in MODELS.items())
    each = f"range(1, {width + 1})"
    bits = ", ".join(f"(mask >> {k}) & 1" for k in range(len(SIGNALS)))
    return f"""
WITH RECURSIVE cases AS ({cases(d)}), rows AS (SELECT [{bits}, 1] AS x, y, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM cases),
-- a bound of the curvature: a quarter of the mean of squared lengths, and the penalty
fast AS (SELECT 1 / (sum(share * list_sum(x)) / 4 + {fixed.PENALTY}) AS rate FROM rows), models(m, allowed) AS (VALUES {models}),
fits AS (
  SELECT 0 AS k, m, allowed, list_transform({each}, lambda i: 0.0::DOUBLE) AS w, list_transform({each}, lambda i: 0.0::DOUBLE) AS v FROM models
  UNION ALL
  SELECT k + 1, m, allowed, new, list_transform({each}, lambda i: new[i] + (CAST(k AS DOUBLE) / (k + 3)) * (new[i] - w[i])) FROM (
    SELECT k, m, any_value(allowed) AS allowed, any_value(w) AS w, list(CASE WHEN i = {width} THEN moved ELSE greatest(0, moved) * allowed[i] END ORDER BY i) AS new FROM (
      SELECT k, m, i, any_value(allowed) AS allowed, any_value(w) AS w, any_value(v[i]) - any_value(rate) * (sum(e * x[i]) + CASE WHEN i = {width} THEN 0 ELSE {fixed.PENALTY} * any_value(v[i]) END) AS moved FROM (
        SELECT a.*, x, rate, share * (1 / (1 + exp(-list_dot_product(CAST(x AS DOUBLE[]), v))) - y) AS e FROM fits a CROSS JOIN rows CROSS JOIN fast WHERE a.k < {steps}
      ) r CROSS JOIN (SELECT unnest({each}) AS i) s GROUP BY k, m, i
    ) g GROUP BY k, m
  ) n
)
SELECT m AS without, unnest([{', '.join(f"'{s}'" for s in (*SIGNALS, 'bias'))}]) AS signal, unnest(list_transform(w, lambda u: round(u, 4) + 0.0)) AS weight FROM fits WHERE k = {steps}"""


PLANS = {"l7_fit_weights": l7_fit_weights}
ORACLES = {"l7_fit_weights": lambda d: _plain_fit(DUCK)}
