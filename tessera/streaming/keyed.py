"""Keyed state with timers: state machines over a stream's keys, in event time, on the RocksDB state store.

A ``Machine`` is plain: its state (a tuple), what a row does to it, when it wants to be woken, and what waking does. ``kept``
runs it as ``transformWithStateInPandas``: rows that come out of order wait in a list state until the watermark has passed them, then
rows and wakings are handled in the order of their times (a row before a waking of the same time, rows of one time by id), so
that the result is that of the sorted rows however they arrive. State is kept by buckets of keys, and one event-time timer a
bucket stands at what comes next in it.
``replayed`` runs the same machine over a whole table in one sorted pass, for backfills.

``m4_`` to ``m16_`` feed the events table as a stream whose rows come late by up to a slice of its time, stop it halfway, and
start it again on the same checkpoint. Each result is a table of what the machine told: user, time (microseconds), the event
that caused it (null: a timer), and what is new.

Defined cases: rows later than DELAY are left out by the watermark; a null key is a key; repeated rows of one time and id are
handled one after the other; rows without a time are left out; an empty stream gives no rows; one key's rows go through one
task, which holds its state and the rows between the watermark and its last row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, StructField, StructType

from tessera.sources.published import workspace
from tessera.streaming.folds import ALLOWED, COOLDOWN_US, arriving, folded

HOUR, SECOND = 3600 * 10**6, 10**6
ROWS = "us long, id long, kind string"
#: Rows of the table for each file of a slice, and for each bucket of keys.
FILE_ROWS, BUCKET_ROWS = 500_000, 10_000
#: The clock's range, which is that of pandas: later times stand at its end. A mark at the end lets every row and waking come: once the watermark is at FAR.
FIRST, LAST, FAR = "1678-01-01", "2262-01-01", 9183110400 * SECOND


class Machine:
    """state: DDL of its state; out: DDL of what it tells, after the time and the event."""

    state: ClassVar[str]
    out: ClassVar[str]
    first: ClassVar[tuple]

    def row(self, state: tuple, us: int, id_: int, kind: str) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        return None

    def wake(self, state: tuple, us: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError


def advanced(machine: Machine, state: tuple, rows: list[tuple], upto: int) -> tuple[tuple, list[tuple]]:
    """Handle sorted rows (us, id, kind) and all wakings up to a time: the new state, what was told as (us, id or None, ...)."""
    told: list[tuple] = []

    def woken(state: tuple, before: int) -> tuple:
        while (at := machine.due(state)) is not None and at < before:
            state, out = machine.wake(state, at)
            told.extend((at, None, *o) for o in out)
        return state

    for us, id_, kind in rows:
        state = woken(state, us)
        state, out = machine.row(state, us, id_, kind)
        told.extend((us, id_, *o) for o in out)
    return woken(state, upto + 1), told


def lists(ddl: str) -> StructType:
    """A list for each column."""
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in StructType.fromDDL(ddl)])


def plain(x):
    """Rows and lists as tuples."""
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


class Ordered(StatefulProcessor):
    """transformWithState's side of a machine, for a bucket of keys at a time, since each value of state is a turn between the engine and Python: the
    states of the bucket's keys as one value of lists, a value of lists for each batch of rows that wait, one timer at what comes next."""

    def __init__(self, machine: Machine, key: str) -> None:
        self.machine, self.key = machine, key
        self.kinds = lists(f"key long, {machine.state}"), lists(f"key long, {ROWS}")
        self.names = StructType.fromDDL(out_ddl(machine, key)).names

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", self.kinds[0])
        self.waiting = handle.getListState("waiting", self.kinds[1])
        self.handled: set = set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            columns = [part[c].tolist() for c in ("key", "us", "id", "kind", "lacks")]
            new = [(None if lacks & 1 else k, us, None if lacks & 2 else i, kind) for k, us, i, kind, lacks in zip(*columns, strict=True) if kind is not None]
            if new:
                self.waiting.appendList([tuple(map(list, zip(*new, strict=True)))])
                self._timer(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if tuple(key) in self.handled:  # the first of a bucket's timers does all there is to do
            return
        self.handled.add(tuple(key))
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        upto = upto if upto < FAR else 1 << 62
        held = self.states.get() if self.states.exists() else None
        states = {k: plain(state) for k, *state in zip(*held, strict=True)} if held else {}
        ready: dict = {}
        later = []
        for part in self.waiting.get():
            for row in zip(*part, strict=True):
                if row[1] <= upto:
                    ready.setdefault(row[0], []).append(row[1:])
                else:
                    later.append(row)
        due = [k for k, state in states.items() if k not in ready and (at := self.machine.due(state)) is not None and at <= upto]
        outs = []
        for k in [*ready, *due]:
            states[k], told = advanced(self.machine, states.get(k, self.machine.first), sorted(ready.get(k, ())), upto)
            outs.extend((k, *out) for out in told)
        if ready or due:
            self.states.update(tuple(map(list, zip(*((k, *state) for k, state in states.items()), strict=True))))
        if ready and later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
        elif ready:
            self.waiting.clear()
        after = [r[1] for r in later] + [at for state in states.values() if (at := self.machine.due(state)) is not None]
        if after:
            self._timer(min(after))
        if outs:
            yield pd.DataFrame(outs, columns=self.names, dtype=object)  # objects, as numbers with nulls would become floats

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(-(-min(us, FAR) // 1000))


def out_ddl(machine: Machine, key: str) -> str:
    return f"{key} long, us long, id long, {machine.out}"


def kept(stream: DataFrame, machine: Machine, key: str, id_: str, time: str, kind: str, delay: str, buckets: int = 256) -> DataFrame:
    """A stream (key: long, id_, time, kind) through a machine; rows of null kind only move the clock. A bucket's keys and waiting rows are in memory
    together: buckets should grow with them, and stay what they are for a checkpoint. delay: less than a year."""
    at, first, last = F.col(time).cast("timestamp"), F.lit(FIRST).cast("timestamp"), F.lit(LAST).cast("timestamp")
    lacks = F.col(key).isNull().cast("int") + F.col(id_).isNull().cast("int") * 2
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))  # noqa: E731  pandas has no null in numbers: lacks tells which are
    rows = stream.where(F.col(time).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), known(key).alias("key"), F.greatest(first, F.least(last, at)).alias("at"), F.unix_micros(at).alias("us"), known(id_).alias("id"), F.col(kind).alias("kind"), lacks.alias("lacks")
    )
    return rows.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(Ordered(machine, key), StructType.fromDDL(out_ddl(machine, key)), "append", "EventTime")


def replayed(df: DataFrame, machine: Machine, key: str, id_: str, time: str, kind: str) -> DataFrame:
    """The same over a table, in one pass over its sorted rows."""
    rows = df.where(F.col(time).isNotNull()).select(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(id_).alias("id"), F.col(kind).alias("kind"))
    # a mark behind each key's rows lets its last wakings come
    ends = rows.groupBy(key).agg(F.lit(1 << 62).alias("us")).select(key, "us", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("kind"))

    def step(state, row):
        state = machine.first if state is None else state
        given = [] if row[3] is None else [row[1:]]
        state, told = advanced(machine, state, given, row[1] - 1 if given else 1 << 62)  # what wakes at a row's time comes after all rows of that time
        return state, [(row[0], *t) for t in told]

    return folded(rows.unionByName(ends), key, ["us", "id"], step, out_ddl(machine, key), many=True)


def replay_of_events(spark: SparkSession, sf_dir: str, parts: int = 4) -> Callable[[int, int], None]:
    """A folder that fills with the events in time slices, of which a tenth comes a slice late; fill(from, to) lets parts come."""
    root = workspace(spark, "slices")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    slice_ = F.floor((F.unix_micros("ts") - F.unix_micros("lo")) * (parts - 1) / (F.unix_micros("hi") - F.unix_micros("lo") + 1)).cast("int")
    late = (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0).cast("int")
    events.join(F.broadcast(ends)).withColumn("part", F.coalesce(slice_, F.lit(0)) + late).drop("lo", "hi").write.partitionBy("part").parquet(f"{root}/all")

    n = events.count()

    def fill(start: int, end: int) -> str:
        for k in range(start, end):
            spark.read.parquet(f"{root}/all").where(F.col("part") == k).drop("part").repartition(fill.files).write.parquet(f"{root}/come/part={k}")
        return f"{root}/come/part=*"

    # a slice is a file for each FILE_ROWS of the table's, and a bucket has BUCKET_ROWS, so that no task grows with the table
    fill.kind, fill.files, fill.buckets = events.schema, 1 + n // FILE_ROWS, 256 + n // BUCKET_ROWS
    return fill


@contextmanager
def rocks(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """State on RocksDB, for the streams that are started meanwhile. idle: batches without rows, which event time needs to wake; by the clock they would never end."""
    held = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.session.timeZone": "UTC", "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ran(spark: SparkSession, sf_dir: str, machine: Machine, parts: int = 4) -> DataFrame:
    """The events through a machine: half of the parts, a stop, the rest from the checkpoint, then the end of time."""
    fill, root = replay_of_events(spark, sf_dir, parts), workspace(spark, "keyed")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    def start(at: str) -> None:
        stream = spark.readStream.schema(fill.kind).option("maxFilesPerTrigger", fill.files).parquet(at)
        # slices are as wide as the delay, and rows come a slice late at most
        told = kept(stream, machine, "user_id", "event_id", "ts", "event_type", f"{2 * 31 // (parts - 1) + 1} days", fill.buckets)
        told.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    with rocks(spark):
        fill(0, parts // 2)
        start(fill(parts // 2, parts // 2))
        fill(parts // 2, parts)
        start(fill(parts, parts))
        end = spark.range(1).select(F.lit(0).cast("long").alias("event_id"), F.lit(0).cast("long").alias("user_id"), F.lit(LAST).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("event_type"))
        end.write.parquet(fill(parts, parts).replace("*", "end"))
        start(fill(parts, parts))
    return spark.read.schema(f"{out_ddl(machine, 'user_id')}, batch int").parquet(f"{root}/out").drop("batch")


def once(stream: DataFrame, key: str, hours: int) -> DataFrame:
    """A stream's rows, each key's first within ``hours`` of its coming, by the engine's own state (a key and when it is forgotten), so that no row goes
    through Python; of rows of one batch that share a key but differ, one."""
    come = stream.withColumn("come_", F.current_timestamp()).withWatermark("come_", f"{hours} hours")
    return come.dropDuplicatesWithinWatermark([key]).drop("come_")


class Cooldown(Machine):
    """M9: a row is taken if COOLDOWN_US have passed since the last that was; else how long it has to wait."""

    state, out, first = "last long", "accepted boolean, wait long", (None,)

    def row(self, state, us, id_, kind):
        left = 0 if state[0] is None else state[0] + COOLDOWN_US - us
        return ((us,), [(True, 0)]) if left <= 0 else (state, [(False, left)])


class Stages(Machine):
    """M5: transitions that the table allows, judged against the last stage that was accepted."""

    state, out, first = "stage string", "before string, kind string, valid boolean", (None,)

    def row(self, state, us, id_, kind):
        valid = state[0] is None or (state[0], kind) in ALLOWED
        return ((kind,) if valid else state), [(state[0], kind, valid)]


def backoff(attempt: int) -> int:
    """Microseconds before the next try: 5 s, doubled each time, 300 s at most."""
    return min(300, 5 * 2 ** min(attempt - 1, 6)) * SECOND


class DeadLetters(Machine):
    """M4: a failure raises the attempt and waits before it is queued again; anything else clears it; the fourth in a row is final."""

    state, out, first, final = "attempt long, due long, dead boolean", "status string, attempt long", (0, None, False), 4

    def row(self, state, us, id_, kind):
        attempt, _, dead = state
        if dead:
            return state, []
        if kind != "error":
            return (0, None, False), ([("queued", 0)] if attempt else [])
        attempt += 1
        if attempt == self.final:
            return (attempt, None, True), [("dead", attempt)]
        return (attempt, us + backoff(attempt), False), [("retry", attempt)]

    def due(self, state):
        return state[1]

    def wake(self, state, us):
        return (state[0], None, False), [("queued", state[0])]


class Snoozes(Machine):
    """M7: a view snoozes an open action, a click opens it early, a timer in time; a purchase completes it for good. Each change is a revision."""

    state, out, first, span = "status string, due long, revision long", "status string, revision long", ("open", None, 0), 36 * HOUR

    def row(self, state, us, id_, kind):
        status, _, revision = state
        to = {("open", "view"): "snoozed", ("snoozed", "click"): "open", ("open", "purchase"): "completed", ("snoozed", "purchase"): "completed"}.get((status, kind))
        if to is None:
            return state, []
        return (to, us + self.span if to == "snoozed" else None, revision + 1), [(to, revision + 1)]

    def due(self, state):
        return state[1]

    def wake(self, state, us):
        return ("open", None, state[2] + 1), [("open", state[2] + 1)]


class Reminders(Machine):
    """M8: a click schedules a reminder two hours on, a purchase dismisses what is scheduled. A due reminder is delivered unless the user's last
    row is an error (the channel is down); then it is tried again after a while, and after four tries it is dead."""

    state, out, first = "waiting array<struct<due: long, event: long, attempt: long>>, last string", "reminder long, status string, attempt long", ((), None)
    after, final = 2 * HOUR, 4

    def row(self, state, us, id_, kind):
        waiting, out = [tuple(w) for w in state[0]], []
        if kind == "purchase":
            waiting, out = [], [(event, "dismissed", attempt) for _, event, attempt in waiting]
        if kind == "click":
            waiting.append((us + self.after, id_, 0))
            out = [(id_, "scheduled", 0)]
        return (tuple(sorted(waiting)), kind), out

    def due(self, state):
        return state[0][0][0] if state[0] else None

    def wake(self, state, us):
        (_, event, attempt), *rest = (tuple(w) for w in state[0])
        attempt += 1
        if state[1] != "error":
            return (tuple(rest), state[1]), [(event, "delivered", attempt)]
        if attempt == self.final:
            return (tuple(rest), state[1]), [(event, "dead", attempt)]
        return (tuple(sorted([*rest, (us + backoff(attempt), event, attempt)])), state[1]), [(event, "retry", attempt)]


class Heartbeats(Machine):
    """A user without a row for twelve hours is stale, till the next one."""

    state, out, first, limit = "last long, stale boolean", "status string", (None, False), 12 * HOUR

    def row(self, state, us, id_, kind):
        return (us, False), ([("alive",)] if state[1] or state[0] is None else [])

    def due(self, state):
        return None if state[0] is None or state[1] else state[0] + self.limit

    def wake(self, state, us):
        return (state[0], True), [("stale",)]


def m4_dead_letter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, DeadLetters())


def m5_stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, Stages())


def m7_snooze_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, Snoozes())


def m8_reminder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, Reminders())


def m9_cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, Cooldown())


def m16_heartbeat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir, Heartbeats())


def m3_seen_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: events that come again (a third of them, in a later batch) are told once, by a state that forgets after thirty days."""
    root = workspace(spark, "once")
    stream = arriving(spark, sf_dir, "events", "event_id").where("event_id is not null").select("event_id", "user_id", "event_type")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    with rocks(spark, idle=False):
        once(stream, "event_id", 30 * 24).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string, batch int").parquet(f"{root}/out").drop("batch")


PLANS = {f.__name__: f for f in (m3_seen_once_stream, m4_dead_letter_stream, m5_stage_stream, m7_snooze_stream, m8_reminder_stream, m9_cooldown_stream, m16_heartbeat_stream)}

_ROWS = "SELECT user_id, event_id AS id, event_type AS kind, epoch_us(ts) AS us, row_number() OVER w AS n, lead(epoch_us(ts)) OVER w AS next_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_NEXT = "FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(ALLOWED))
_TO = "CASE WHEN {s} = 'open' AND {k} = 'view' THEN 'snoozed' WHEN {s} = 'snoozed' AND {k} = 'click' THEN 'open' WHEN {s} IN ('open', 'snoozed') AND {k} = 'purchase' THEN 'completed' END"
_MORE = "CASE WHEN {k} = 'error' THEN {a} + 1 ELSE 0 END"
#: A row after the other by recursion, wakings from where a state stood until the next row.
ORACLES = {
    "m3_seen_once_stream": lambda d: "SELECT event_id, user_id, event_type FROM events WHERE event_id IS NOT NULL",
    "m9_cooldown_stream": lambda d: f"""WITH RECURSIVE o AS ({_ROWS}), f AS (
      SELECT user_id, n, us, id, us AS last, true AS accepted, 0::BIGINT AS wait FROM o WHERE n = 1 UNION ALL
      SELECT o.user_id, o.n, o.us, o.id, CASE WHEN o.us - f.last >= {COOLDOWN_US} THEN o.us ELSE f.last END, o.us - f.last >= {COOLDOWN_US}, greatest(0, f.last + {COOLDOWN_US} - o.us) {_NEXT}
    ) SELECT user_id, us, id, accepted, wait FROM f""",
    "m5_stage_stream": lambda d: f"""WITH RECURSIVE o AS ({_ROWS}), f AS (
      SELECT user_id, n, us, id, NULL::VARCHAR AS before, kind, true AS valid, kind AS stage FROM o WHERE n = 1 UNION ALL
      SELECT o.user_id, o.n, o.us, o.id, f.stage, o.kind, (f.stage, o.kind) IN ({_PAIRS}), CASE WHEN (f.stage, o.kind) IN ({_PAIRS}) THEN o.kind ELSE f.stage END {_NEXT}
    ) SELECT user_id, us, id, before, kind, valid FROM f""",
    "m4_dead_letter_stream": lambda d: f"""WITH RECURSIVE o AS ({_ROWS}), f AS (
      SELECT user_id, n, us, id, next_us, kind, 0 AS had, false AS was_dead, {_MORE.format(k="kind", a="0")} AS attempt FROM o WHERE n = 1 UNION ALL
      SELECT o.user_id, o.n, o.us, o.id, o.next_us, o.kind, f.attempt, f.was_dead OR f.attempt = 4, CASE WHEN f.was_dead OR f.attempt = 4 THEN f.attempt ELSE {_MORE.format(k="o.kind", a="f.attempt")} END {_NEXT}
    ), g AS (SELECT *, us + 1000000 * least(300, 5 * CAST(power(2, least(attempt - 1, 6)) AS BIGINT)) AS due FROM f WHERE NOT was_dead)
    SELECT user_id, us, id, CASE WHEN kind <> 'error' THEN 'queued' WHEN attempt = 4 THEN 'dead' ELSE 'retry' END AS status, CAST(attempt AS BIGINT) AS attempt FROM g WHERE kind = 'error' OR had > 0
    UNION ALL SELECT user_id, due, NULL, 'queued', attempt FROM g WHERE attempt BETWEEN 1 AND 3 AND (next_us IS NULL OR due < next_us)""",
    "m7_snooze_stream": lambda d: f"""WITH RECURSIVE o AS ({_ROWS}), f AS (
      SELECT user_id, n, us, next_us, id, {_TO.format(s="'open'", k="kind")} AS told, coalesce({_TO.format(s="'open'", k="kind")}, 'open') AS status,
        CASE WHEN kind IN ('view', 'purchase') THEN 1 ELSE 0 END AS revision, CASE WHEN kind = 'view' THEN us + {Snoozes.span} END AS due FROM o WHERE n = 1 UNION ALL
      SELECT user_id, n, us, next_us, id, told, coalesce(told, s), r + CASE WHEN told IS NULL THEN 0 ELSE 1 END, CASE WHEN told = 'snoozed' THEN us + {Snoozes.span} WHEN told IS NULL THEN due END FROM
        (SELECT *, {_TO.format(s="s", k="kind")} AS told FROM (SELECT o.*, CASE WHEN f.due < o.us THEN 'open' ELSE f.status END AS s, f.revision + CASE WHEN f.due < o.us THEN 1 ELSE 0 END AS r, CASE WHEN f.due < o.us THEN NULL ELSE f.due END AS due {_NEXT}) a) b
    ) SELECT user_id, us, id, told AS status, CAST(revision AS BIGINT) AS revision FROM f WHERE told IS NOT NULL
    UNION ALL SELECT user_id, due, NULL, 'open', revision + 1 FROM f WHERE due IS NOT NULL AND (next_us IS NULL OR due < next_us)""",
    "m8_reminder_stream": lambda d: f"""WITH o AS ({_ROWS}), ended AS (
      SELECT user_id, id, us, us + {Reminders.after} AS due, min(CASE WHEN kind = 'purchase' THEN row(n, us, id) END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p, kind FROM o
    ), tries AS (
      SELECT user_id, id, us, p, k, due + 1000000 * [0, 5, 15, 35][k] AS try_us FROM ended CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) WHERE kind = 'click'
    ), judged AS (
      SELECT t.*, coalesce(p[2] <= t.try_us, false) AS gone, o.kind <> 'error' AS ok FROM tries t ASOF JOIN (SELECT user_id, us, last(kind ORDER BY n) AS kind FROM o GROUP BY user_id, us) o ON o.user_id = t.user_id AND o.us <= t.try_us
    ), ends AS (SELECT user_id, id, min(CASE WHEN ok OR gone OR k = 4 THEN k END) AS s FROM judged GROUP BY user_id, id)
    SELECT user_id, us, id, id AS reminder, 'scheduled' AS status, 0::BIGINT AS attempt FROM o WHERE kind = 'click'
    UNION ALL SELECT user_id, CASE WHEN gone THEN p[2] ELSE try_us END, CASE WHEN gone THEN p[3] END, id, CASE WHEN gone THEN 'dismissed' WHEN ok THEN 'delivered' WHEN k = 4 THEN 'dead' ELSE 'retry' END, CASE WHEN gone THEN k - 1 ELSE k END
      FROM judged JOIN ends USING (user_id, id) WHERE k <= s""",
    "m16_heartbeat_stream": lambda d: f"""WITH o AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY n) AS before FROM ({_ROWS}) r)
    SELECT user_id, us, id, 'alive' AS status FROM o WHERE before IS NULL OR us - before > {Heartbeats.limit}
    UNION ALL SELECT user_id, us + {Heartbeats.limit}, NULL, 'stale' FROM o WHERE next_us IS NULL OR next_us > us + {Heartbeats.limit}""",
}
