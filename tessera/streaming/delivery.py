"""A delivery loop over a stored outbox: claim, deliver, retry and dead letters, by the batches of a stream.

A batch claims what is new and what an earlier batch left to be tried again, writes the claims under its number, delivers from what it
wrote, and writes the outcomes under its number. A batch that is run again after a crash overwrites its own claims and
outcomes, so that a row is delivered once in the table however often a run stops between claim and delivery. After
the last batch further rounds are run until nothing waits.

Outcomes: sent; retry (the channel is down for now: again in the next round); blocked (never deliverable); dead (the last try failed).

Defined cases: repeated rows of one id are one delivery; a null id is refused; an empty stream leaves an empty outbox.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.cells import saved
from tessera.sources.published import workspace
from tessera.streaming.folds import unseen

TRIES = 3


class Outbox:
    """claims and outcomes of a loop, in a shared folder; deliver(claims, round) -> claims and their outcome (sent, retry or blocked)."""

    def __init__(self, spark: SparkSession, key: str, deliver: Callable[[DataFrame, int], DataFrame], tries: int = TRIES, name: str = "outbox") -> None:
        self.spark, self.key, self.deliver, self.tries = spark, key, deliver, tries
        self.root = workspace(spark, name)

    def outcomes(self, number: int) -> DataFrame | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/outcomes/round={number}/_SUCCESS")
        done = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)
        return self.spark.read.parquet(f"{self.root}/outcomes/round={number}") if done else None

    def claim(self, new: DataFrame | None, number: int) -> None:
        """What is new (unless an earlier round has claimed it) and what the round before left."""
        before = self.outcomes(number - 1) if number else None
        again = before.where("status = 'retry'").drop("status") if before is not None else None
        if new is not None:
            earlier = self.spark.read.option("basePath", f"{self.root}/claims").parquet(f"{self.root}/claims").where(F.col("round") < number) if number else None
            rows = unseen(new.where(F.col(self.key).isNotNull()), earlier, self.key).withColumn("attempt", F.lit(1))
            again = rows if again is None else rows.unionByName(again.withColumn("attempt", F.col("attempt") + 1))
        else:
            again = again.withColumn("attempt", F.col("attempt") + 1)
        again.write.mode("overwrite").parquet(f"{self.root}/claims/round={number}")

    def settle(self, number: int) -> None:
        claims = self.spark.read.parquet(f"{self.root}/claims/round={number}")
        told = self.deliver(claims, number)
        status = F.when((F.col("outcome") == "retry") & (F.col("attempt") >= self.tries), "dead").otherwise(F.col("outcome"))
        told.select(*claims.columns, status.alias("status")).write.mode("overwrite").parquet(f"{self.root}/outcomes/round={number}")

    def batch(self, rows: DataFrame, number: int) -> None:
        self.claim(rows, number)
        self.settle(number)

    def drain(self, number: int) -> int:
        """Rounds without new rows until none waits, ``tries`` at most; the number after the last."""
        while (last := self.outcomes(number - 1) if number else None) is not None and not last.where("status = 'retry'").isEmpty():
            self.claim(None, number)
            self.settle(number)
            number += 1
        return number

    def run(self, stream: DataFrame) -> None:
        """The stream to its end, from where its checkpoint stands."""
        stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start().awaitTermination()

    def table(self) -> DataFrame:
        """Each row's last outcome, its attempt and round."""
        return self.spark.read.option("basePath", f"{self.root}/outcomes").parquet(f"{self.root}/outcomes").where("status <> 'retry'")


def month(at: Column) -> Column:
    return F.coalesce(F.month(at), F.lit(5)) - 1


def m8_delivery_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale's client is told by e-mail in the month the sale arrives. A client that is known only later (by the month of its record) is tried again, three times at most; without an address nothing can be sent."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").where("sale_id is not null").select("sale_id", "client_id", month(F.col("arrived_at")).alias("month"))
    root = workspace(spark, "sales")
    newest = F.max(F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), "email"))
    # written once: a join with a plain table can be split where one client has a third of the sales
    clients = saved(spark.read.parquet(f"{sf_dir}/clients.parquet").where("client_id is not null").groupBy("client_id").agg(newest.alias("c")).select(F.col("client_id").alias("of"), "c.email", F.when(F.year("c.at") < 2024, 0).otherwise(F.month("c.at") - 1).alias("since")), "clients")

    def deliver(claims: DataFrame, number: int) -> DataFrame:
        known = claims.join(clients, claims["client_id"] == clients["of"], "left")
        outcome = F.when(F.col("of").isNull() | ~F.coalesce(F.col("email").contains("@"), F.lit(False)), "blocked").when(F.col("since") <= number, "sent").otherwise("retry")
        return known.withColumn("outcome", outcome)

    box = Outbox(spark, "sale_id", deliver)
    stream = spark.readStream.schema(sales.drop("month").schema).parquet(f"{root}/month=*")
    # a month comes, the loop is started on its checkpoint, and ends: a batch a month
    for k in range(5):
        sales.where(F.col("month") == k).drop("month").write.parquet(f"{root}/month={k}")
        box.run(stream)
    box.drain(5)
    return box.table().select("sale_id", "client_id", F.col("attempt").cast("long").alias("attempt"), "status", F.col("round").cast("long").alias("round"))


PLANS = {"m8_delivery_loop": m8_delivery_loop}
ORACLES = {
    "m8_delivery_loop": lambda d: """WITH c AS (SELECT client_id, first(email ORDER BY coalesce(updated_at, TIMESTAMP '1970-01-01') DESC, email DESC NULLS LAST) AS email, CASE WHEN coalesce(max(year(updated_at)), 1970) < 2024 THEN 0 ELSE month(max(updated_at)) - 1 END AS since FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
    s AS (SELECT sale_id, any_value(client_id) AS client_id, min(coalesce(month(arrived_at), 5) - 1) AS b FROM sales WHERE sale_id IS NOT NULL GROUP BY sale_id)
    SELECT sale_id, s.client_id, CASE WHEN c.client_id IS NULL OR coalesce(email NOT LIKE '%@%', true) THEN 1::BIGINT ELSE least(3, greatest(1, since - b + 1)) END AS attempt, CASE WHEN c.client_id IS NULL OR coalesce(email NOT LIKE '%@%', true) THEN 'blocked' WHEN since > b + 2 THEN 'dead' ELSE 'sent' END AS status,
      b + attempt - 1 AS round FROM s LEFT JOIN c ON c.client_id = s.client_id"""
}
