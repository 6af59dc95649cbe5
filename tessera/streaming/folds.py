"""Stateful operators: folds over sorted rows that hold one state, and streams in micro-batches.

A fold reads rows sorted by key and order and holds one key's state, however many rows the key has; it runs on Arrow
batches. Streams go by ``foreachBatch``: a batch's rows are written once by its number, after those that earlier batches
have are left out, so that late, repeated and replayed rows change nothing.

Defined cases: null keys are one key; an empty table gives an empty result; rows that repeat an order follow each other by
the further order columns; a batch that is run again overwrites its own part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import SPARK
from tessera.sources.published import workspace

COOLDOWN_US = 6 * 3600 * 10**6
#: The transitions that the table allows: from, to.
ALLOWED = frozenset({("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("error", "view"), ("purchase", "view"), ("view", "error"), ("click", "error")})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def folded(df: DataFrame, key: str, order: list[str], step: Callable, ddl: str, many: bool = False) -> DataFrame:
    """step(state or None, row as a tuple of df's columns) -> new state, output row or None (many: output rows); the state begins anew with each key."""
    at, names = df.columns.index(key), [c.split()[0] for c in ddl.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no key is this
        state = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != now:
                    now, state = row[at], None
                state, given = step(state, row)
                if many:
                    out.extend(given)
                elif given is not None:
                    out.append(given)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def accepted(last: int | None, row: tuple) -> tuple[int, tuple]:
    """Greedy acceptance: a row (key, id, microseconds) passes if the last that passed is a cooldown away."""
    ok = last is None or row[2] - last >= COOLDOWN_US
    return (row[2] if ok else last), (row[0], row[1], ok)


def cooldown_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: a user's event is taken if six hours have passed since the last that was."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    return folded(_events(spark, sf_dir).select("user_id", "event_id", micros), "user_id", ["us", "event_id"], accepted, "user_id long, event_id long, accepted boolean")


def moved(state: str | None, row: tuple) -> tuple[str, tuple]:
    """A row (key, id, next state) is a transition from the last accepted state; the first of a key is its state."""
    valid = state is None or (state, row[2]) in ALLOWED
    return (row[2] if valid else state), (row[0], row[1], state, row[2], valid)


def state_machine_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions that the table allows, judged against the last state that was accepted."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return folded(rows, "user_id", ["event_id"], moved, "user_id long, event_id long, before string, event_type string, valid boolean")


def streamed(spark: SparkSession, source: DataFrame, step: Callable[[DataFrame, DataFrame | None], DataFrame], name: str) -> DataFrame:
    """Run a stream to its end; step(batch, what earlier batches wrote) is written once by the batch's number; the table that results."""
    root = workspace(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        earlier = batch.sparkSession.read.parquet(f"{root}/out").where(F.col("batch") < number).drop("batch") if number else None
        step(batch, earlier).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several batches: five parts by hash of the id, so that rows come late and out of order, and a sixth that replays a third of all."""
    root = workspace(spark, "parts")
    events = _events(spark, sf_dir)
    for k in range(5):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).write.parquet(f"{root}/part={k}")
    events.where("event_id % 3 = 0").write.parquet(f"{root}/part=5")
    return by_parts(spark, root, events)


def by_parts(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Written parts as a stream that takes as many files a batch as the first part has: as many batches as parts, however many tasks write and read one."""
    files = len(spark.read.parquet(f"{root}/part=0").inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/part=*")


def unseen(batch: DataFrame, earlier: DataFrame | None, key: str = "event_id") -> DataFrame:
    """The rows of a batch whose key no earlier batch wrote, each once; the earlier ones grow without end, so both sides are dealt by key and neither passes the driver."""
    new = batch.dropDuplicates([key])
    return new if earlier is None else new.join(earlier.select(key).hint("merge"), key, "left_anti").select(batch.columns)


def a1_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the cursor (the checkpoint), whenever they come, each once: what is told is judged against the written table, not against a watermark."""
    return streamed(spark, parted(spark, sf_dir).select("event_id", "user_id", "event_type"), unseen, "feed")


def arriving(spark: SparkSession, sf_dir: str, table: str, key: str, parts: int = 3) -> DataFrame:
    """A table as a stream of several batches: parts by hash of the key, and a last one that replays a third of all."""
    root = workspace(spark, "parts")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    h = F.xxhash64(key)
    for k in range(parts):
        rows.where(F.pmod(h, F.lit(parts)) == k).write.parquet(f"{root}/part={k}")
    rows.where(F.pmod(h, F.lit(3)) == 0).write.parquet(f"{root}/part={parts}")
    return by_parts(spark, root, rows)


def stages(batch: DataFrame) -> DataFrame:
    """A batch of documents through the stages of a cycle, by the same texts as the whole table: risk report, money record, what is to be told."""
    from tessera.plans.money import records
    from tessera.plans.signals import l5_risk_report

    batch.createOrReplaceTempView("documents")
    spark = batch.sparkSession
    return spark.sql(cycle(SPARK, l5_risk_report(SPARK), records(SPARK)))


def cycle(d, risk: str, records: str) -> str:
    told = "CASE WHEN band = 'high' THEN 'warn' WHEN kind IS NOT NULL THEN 'ledger' ELSE 'none' END"
    return f"SELECT r.id, r.score, r.band, r.findings, m.kind, m.amount_minor, m.currency, {told} AS told FROM ({risk}) r LEFT JOIN {records} m ON m.id = r.id"


def m1_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: each cycle takes the messages that are new, scores their risk, reads their money and decides what is told; the batches' results are those of the whole table."""

    def step(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        new = batch.dropDuplicates(["doc_id"])
        new = new if earlier is None else new.join(earlier.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_anti").select(batch.columns)
        return stages(new)

    return streamed(spark, arriving(spark, sf_dir, "documents", "doc_id"), step, "cycle")


def _whole(d) -> str:
    from tessera.plans.money import records
    from tessera.plans.signals import l5_risk_report

    return cycle(d, l5_risk_report(d), records(d))


PLANS = {f.__name__: f for f in (cooldown_accept, state_machine_fold, a1_change_feed, m1_micro_batches)}

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(ALLOWED))
ORACLES = {
    # one row of each user after the other
    "cooldown_accept": lambda d: """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, us AS last, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.us - f.last >= 21600000000 THEN o.us ELSE f.last END, o.us - f.last >= 21600000000
      FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1) SELECT user_id, event_id, accepted FROM f""",
    "state_machine_fold": lambda d: f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, CAST(NULL AS VARCHAR) AS before, event_type, event_type AS state, true AS valid FROM o WHERE n = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.n, f.state, o.event_type, CASE WHEN (f.state, o.event_type) IN ({_PAIRS}) THEN o.event_type ELSE f.state END, (f.state, o.event_type) IN ({_PAIRS})
      FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1) SELECT user_id, event_id, before, event_type, valid FROM f""",
    "a1_change_feed": lambda d: "SELECT event_id, user_id, event_type FROM events",
    "m1_micro_batches": _whole,
}
