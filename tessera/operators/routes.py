"""Read routes as functions of DataFrames: what happened to a message, and how all accounts stand.

``history`` reads one message's revisions, attempts and predictions, newest first. ``status`` makes one row an account, of all accounts at
once: tasks by status, what is active by source, what of the index is missing, and whether the provider can be reached (the leading run of
failures among the newest jobs, of which every task keeps only so many an account before rows are shuffled).

Defined cases: a message of another account, or none, is a ``LookupError``; accounts that only some tables know have zeros; null
accounts are no accounts; ties of the newest go by id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a history's part; jobs that are looked back on; statuses of tasks.
MOST, JOBS = 50, 30
ACTIVE, FINISHED = ("queued", "retry", "running"), ("complete", "dead")


def history(messages: DataFrame, account: object, id_: object, most: int = MOST, **parts: DataFrame) -> dict[str, DataFrame]:
    """messages (account, id); parts by name (account, id, number, ...) -> of each part the message's newest rows, by number."""
    own = (F.col("account").eqNullSafe(F.lit(account))) & (F.col("id").eqNullSafe(F.lit(id_)))
    if messages.where(own).isEmpty():
        raise LookupError(f"{id_} is no message of {account}")
    return {name: part.where(own).orderBy(F.desc("number")).limit(most).drop("account", "id") for name, part in parts.items()}


def _counts(rows: DataFrame, column: str, of: Mapping[str, object]) -> DataFrame:
    return rows.where("account is not null").groupBy("account").agg(*(F.count_if(F.col(column).isin(*v) if isinstance(v, Sequence) and not isinstance(v, str) else F.col(column) == v).alias(k) for k, v in of.items()))


def status(tasks: DataFrame, index: DataFrame, jobs: DataFrame, unreachable: Sequence[str], active: Sequence[str] = ACTIVE, finished: Sequence[str] = FINISHED, sources: Sequence[str] = ("live", "backlog")) -> DataFrame:
    """tasks (account, status, source), index (account, state), jobs (account, number, code) -> account, tasks, active, finished, active_<source> ..., pending, indexed, failed, failed_checks, retry_seconds (null if reachable)."""
    live = F.col("status").isin(*active)
    done = tasks.where("account is not null").groupBy("account").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(live).alias("active"), F.count_if(F.col("status").isin(*finished)).alias("finished"), *(F.count_if(live & (F.col("source") == s)).alias(f"active_{s}") for s in sources)
    )
    held = _counts(index, "state", {s: s for s in ("pending", "indexed", "failed")})
    newest = Window.partitionBy("account").orderBy(F.desc("number"))
    # the limit on the rank is put before the shuffle as well
    last = jobs.where("account is not null").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= JOBS)
    bad = F.coalesce(F.col("code").isin(*unreachable), F.lit(False))
    checks = last.groupBy("account").agg(F.coalesce(F.min(F.when(~bad, F.col("place"))) - 1, F.count(F.lit(1))).cast("long").alias("failed_checks"))
    df = done.join(held, "account", "full").join(checks, "account", "full").na.fill(0)
    wait = F.least(F.lit(60), 5 * F.pow(F.lit(2), F.least(F.col("failed_checks") - 1, F.lit(6)))).cast("long")
    return df.withColumn("retry_seconds", F.when(F.col("failed_checks") > 0, wait))


def account_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of all clients of the shop: sales are their tasks (open ones are active; high and low priority their sources), changes their index (deletions fail it), clicks their jobs (errors don't reach)."""
    sales, changes, clicks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "client_changes", "clicks"))
    tasks = sales.select(F.col("client_id").alias("account"), "status", F.when(F.col("priority") <= 2, "live").otherwise("backlog").alias("source"))
    index = changes.select(F.col("client_id").alias("account"), F.when(F.col("op") == "D", "failed").when(F.col("op") == "I", "pending").otherwise("indexed").alias("state"))
    jobs = clicks.dropDuplicates(["click_id"]).select(F.col("client_id").alias("account"), F.col("click_id").alias("number"), F.col("kind").alias("code"))
    return status(tasks, index, jobs, ["error"], ["open"], ["done"])


PLANS = {"account_status": account_status}
ORACLES = {
    "account_status": lambda d: """WITH t AS (SELECT client_id AS account, count(*) AS tasks, count_if(status = 'open') AS active, count_if(status = 'done') AS finished, count_if(status = 'open' AND priority <= 2) AS active_live, count_if(status = 'open' AND (priority > 2 OR priority IS NULL)) AS active_backlog FROM sales WHERE client_id IS NOT NULL GROUP BY 1),
      i AS (SELECT client_id AS account, count_if(op = 'I') AS pending, count_if(op IS DISTINCT FROM 'D' AND op IS DISTINCT FROM 'I') AS indexed, count_if(op = 'D') AS failed FROM client_changes WHERE client_id IS NOT NULL GROUP BY 1),
      j AS (SELECT account, coalesce(min(CASE WHEN code IS DISTINCT FROM 'error' THEN place END) - 1, count(*)) AS failed_checks FROM (SELECT client_id AS account, kind AS code, row_number() OVER (PARTITION BY client_id ORDER BY click_id DESC) AS place FROM (SELECT DISTINCT ON (click_id) * FROM clicks) c WHERE client_id IS NOT NULL) x WHERE place <= 30 GROUP BY account)
      SELECT account, CAST(coalesce(tasks, 0) AS BIGINT) AS tasks, CAST(coalesce(active, 0) AS BIGINT) AS active, CAST(coalesce(finished, 0) AS BIGINT) AS finished, CAST(coalesce(active_live, 0) AS BIGINT) AS active_live, CAST(coalesce(active_backlog, 0) AS BIGINT) AS active_backlog, CAST(coalesce(pending, 0) AS BIGINT) AS pending, CAST(coalesce(indexed, 0) AS BIGINT) AS indexed, CAST(coalesce(failed, 0) AS BIGINT) AS failed,
        coalesce(failed_checks, 0) AS failed_checks, CASE WHEN failed_checks > 0 THEN CAST(least(60, 5 * power(2, least(failed_checks - 1, 6))) AS BIGINT) END AS retry_seconds FROM t FULL JOIN i USING (account) FULL JOIN j USING (account)"""
}
