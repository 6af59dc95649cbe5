"""Sketches that are stored by day and merged: KLL quantiles, HLL counts of distinct keys.

A day's rows make one small row a group, whatever their number; months, quarters or any span are answered by merging
those rows, without the data. Error bounds: a KLL quantile of parameter K is off by RANK of the rows at most (with 99 %), an HLL
count of 2 ** LG registers by DISTINCT of the count (three standard errors).

Defined cases: null values are in no quantile, null keys in no count; a span without values has null quantiles and counts 0;
days are of the session's zone; repeated rows count each in quantiles and once in counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.cells import saved

#: Parameters, and the errors they stand for.
K, LG = 400, 12
RANK, DISTINCT = 0.01, 3 * 1.04 / 2 ** (LG / 2)


def sketched(rows: DataFrame, by: Sequence[str], at: str, value: str, key: str) -> DataFrame:
    """by, day, n, quantiles, keys (sketches): one row a group and day."""
    measured = F.col(value).cast("double")
    return rows.groupBy(*by, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(measured, K).alias("quantiles"), F.hll_sketch_agg(F.col(key).cast("string"), LG).alias("keys"))


def merged(stored: DataFrame, by: Sequence[str | Column], points: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """by, n, quantiles at the points (null without values), distinct keys: from days' rows alone."""
    df = stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("q"), F.hll_union_agg("keys").alias("h"))
    some = F.kll_sketch_get_n_double("q") > 0
    kept = [c for c in df.columns if c not in ("q", "h")]
    return df.select(*kept, *(F.when(some, F.kll_sketch_get_quantile_double("q", F.lit(p))).alias(f"p{round(100 * p)}") for p in points), F.hll_sketch_estimate("h").alias("distinct"))


def sketch_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, D23 by sketches: of each kind of click and month the rows, and whether median, 95th percentile and number of clients, merged from the days' stored sketches, keep their stated errors against exact values."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").where("ts is not null")
    days = saved(sketched(clicks, ["kind"], "ts", "value", "client_id"), "sketches")
    got = merged(days, ["kind", F.date_trunc("month", "day").cast("date").alias("month")])
    got = got.select(F.col("kind").alias("k"), F.col("month").alias("m"), "n", "p50", "p95", "distinct")
    own = clicks.select("kind", F.date_trunc("month", "ts").cast("date").alias("month"), F.col("value").cast("double").alias("value"), "client_id")
    # twelve rows a kind and year
    own = own.join(F.broadcast(got), own["kind"].eqNullSafe(got["k"]) & (own["month"] == got["m"]))
    share = lambda p, op: F.avg(F.when(F.col("value").isNotNull(), op(F.col("value"), F.col(p)).cast("double")))
    inside = lambda p, at: (share(p, lambda a, b: a < b) <= at + RANK) & (share(p, lambda a, b: a <= b) >= at - RANK)
    exact = F.count_distinct("client_id")
    return own.groupBy("kind", "month").agg(
        F.max("n").alias("n"), inside("p50", 0.5).alias("median_kept"), inside("p95", 0.95).alias("p95_kept"), (F.abs(F.max("distinct") - exact) <= F.greatest(F.lit(1.0), DISTINCT * exact)).alias("clients_kept")
    ).select("kind", F.date_format("month", "yyyy-MM").alias("month"), "n", "median_kept", "p95_kept", "clients_kept")


PLANS = {"sketch_months": sketch_months}
ORACLES = {"sketch_months": lambda d: "SELECT kind, strftime(ts, '%Y-%m') AS month, count(*) AS n, true AS median_kept, true AS p95_kept, true AS clients_kept FROM clicks WHERE ts IS NOT NULL GROUP BY 1, 2"}
