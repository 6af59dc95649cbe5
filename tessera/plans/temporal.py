"""Joins and groups by time: as-of joins, interval joins, sessions; keys that hold a third of all rows are parted by time.

``asof``: both sides are dealt by key and a bucket of time. A bucket finds its rows' latest match by one running maximum, and
where it has none yet, the key's latest of earlier buckets, which comes from one row a bucket. ``within``: the left side is
dealt to the bins that its interval touches, the right side to its own, and only rows of one key and bin meet; ``counted`` sums what it would pair without pairing. ``sessions``:
runs of a bucket are found first, and runs of a key are then joined where they are near; so no task orders all of a key's rows.

Defined cases: rows with a null key or time match nothing (left rows of ``asof`` stay, with nulls; they are in no session);
a right row of the same time counts; of several right rows of one time the greatest by its values counts; repeated rows count
each; times are timestamps with or without a zone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.cells import saved

DAY, HOUR, MINUTE = 86_400, 3600, 60


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def binned(us: Column, width: int) -> Column:
    return F.floor(us / (width * 10**6)).cast("long")


def asof(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, values: Sequence[str], width: int = DAY) -> DataFrame:
    """left's columns, and ``values`` of right's latest row of the key at or before left's time."""
    lost = F.col(key).isNull() | F.col(at_left).isNull()
    row = F.struct(*(F.col(c) for c in left.columns))
    found = F.struct(micros(F.col(at_right)).alias("us"), *(F.col(v) for v in values))
    a = left.where(~lost).select(F.col(key).alias("k"), micros(F.col(at_left)).alias("us"), F.lit(1).alias("side"), row.alias("row"))
    b = right.where(F.col(key).isNotNull() & F.col(at_right).isNotNull()).select(F.col(key).alias("k"), micros(F.col(at_right)).alias("us"), F.lit(0).alias("side"), found.alias("v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("bin", binned(F.col("us"), width))
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k", "bin").agg(F.max("v").alias("last")).select("k", "bin", F.max("last").over(before).alias("carried"))
    upto = Window.partitionBy("k", "bin").orderBy("us", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.max("v").over(upto)).where("side = 1").join(carried, ["k", "bin"])
    got = seen.select("row.*", F.coalesce("seen", "carried").alias("_m")).select(*left.columns, *(F.col(f"_m.{v}").alias(v) for v in values))
    kinds = {f.name: f.dataType for f in right.schema.fields}
    return got.unionByName(left.where(lost).select("*", *(F.lit(None).cast(kinds[v]).alias(v) for v in values)))


def within(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, back: int) -> DataFrame:
    """Pairs (l, r: structs) of one key where right's time is at most ``back`` seconds before left's, and not after it."""
    a = left.where(F.col(key).isNotNull() & F.col(at_left).isNotNull()).select(F.struct("*").alias("l"), F.col(key).alias("k"), micros(F.col(at_left)).alias("us"))
    b = right.where(F.col(key).isNotNull() & F.col(at_right).isNotNull()).select(F.struct("*").alias("r"), F.col(key).alias("rk"), micros(F.col(at_right)).alias("rus"))
    a = a.withColumn("bin", F.explode(F.sequence(binned(F.col("us") - back * 10**6, back), binned(F.col("us"), back))))
    b = b.withColumn("rbin", binned(F.col("rus"), back))
    return a.join(b, (F.col("k") == F.col("rk")) & (F.col("bin") == F.col("rbin"))).where((F.col("rus") <= F.col("us")) & (F.col("rus") >= F.col("us") - back * 10**6)).select("l", "r")


def counted(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, back: int, sums: Mapping[str, Column], width: int = DAY) -> DataFrame:
    """left's columns and, of the right rows that ``within`` would pair with each, the sums of expressions over right (whole numbers): a
    running sum at the interval's end less one before its beginning, so that no pair is made however dense a key is."""
    own = saved(left.withColumn("_n", F.monotonically_increasing_id()), "left")
    ends = F.array(F.struct(micros(F.col(at_left)).alias("us"), F.lit(1).alias("sign")), F.struct((micros(F.col(at_left)) - back * 10**6 - 1).alias("us"), F.lit(-1).alias("sign")))
    a = own.where(F.col(key).isNotNull() & F.col(at_left).isNotNull()).select(F.col(key).alias("k"), "_n", F.explode(ends).alias("e")).select("k", "_n", "e.us", "e.sign")
    b = right.where(F.col(key).isNotNull() & F.col(at_right).isNotNull()).select(F.col(key).alias("k"), micros(F.col(at_right)).alias("us"), F.lit(0).alias("sign"), *(c.cast("long").alias(f"s_{n}") for n, c in sums.items()))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("bin", binned(F.col("us"), width))
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k", "bin").agg(*(F.sum(f"s_{n}").alias(f"s_{n}") for n in sums)).select("k", "bin", *(F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0)).alias(f"c_{n}") for n in sums))
    # right rows of one time come first
    upto = Window.partitionBy("k", "bin").orderBy("us", F.abs("sign")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("*", *(F.coalesce(F.sum(f"s_{n}").over(upto), F.lit(0)).alias(f"r_{n}") for n in sums)).where("sign <> 0").join(carried, ["k", "bin"])
    got = seen.groupBy("_n").agg(*(F.sum(F.col("sign") * (F.col(f"r_{n}") + F.col(f"c_{n}"))).alias(n) for n in sums))
    return own.join(got, "_n", "left").select(*left.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in sums))


def sessions(rows: DataFrame, key: str, at: str, gap: int, width: int = DAY) -> DataFrame:
    """key, began, ended (microseconds), n: a session ends where the next row of its key is ``gap`` seconds or more away."""
    df = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), micros(F.col(at)).alias("us")).withColumn("bin", binned(F.col("us"), width))
    far = gap * 10**6
    inside = Window.partitionBy(key, "bin").orderBy("us")
    df = df.withColumn("new", F.coalesce(F.col("us") - F.lag("us").over(inside) >= far, F.lit(True)).cast("int"))
    df = df.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = df.groupBy(key, "bin", "run").agg(F.min("us").alias("began"), F.max("us").alias("ended"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("began")
    runs = runs.withColumn("new", F.coalesce(F.col("began") - F.lag("ended").over(order) >= far, F.lit(True)).cast("int"))
    runs = runs.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "session").agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n").alias("n")).drop("session")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click once: repeated rows are the same click."""
    last = F.max(F.struct("ts", "client_id", "kind"))
    return _table(spark, sf_dir, "clicks").where("click_id is not null").groupBy("click_id").agg(last.alias("c")).select("click_id", "c.*")


def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: what a client did last before each sale."""
    sales = _table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    return asof(sales, _clicks(spark, sf_dir), "client_id", "sold_at", "ts", ["ts", "click_id", "kind"]).select("sale_id", "client_id", "click_id", "kind")


def interval_clicks_before_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: a client's clicks in the hour up to each sale, by kind; of a sale whose clicks have no kind it isn't known how many were purchases."""
    sales = _table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    sums = {"clicks": F.lit(1), "kinds": F.col("kind").isNotNull().cast("int"), "purchases": F.coalesce((F.col("kind") == "purchase").cast("int"), F.lit(0))}
    got = counted(sales, _clicks(spark, sf_dir), "client_id", "sold_at", "ts", HOUR, sums)
    known = F.when(F.col("kinds") > 0, F.col("purchases"))
    return got.where("clicks > 0").groupBy("sale_id").agg(F.sum("clicks").alias("clicks"), F.sum(known).alias("purchases"))


def client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: runs of a client's clicks with less than half an hour between them."""
    return sessions(_clicks(spark, sf_dir), "client_id", "ts", 30 * MINUTE)


PLANS = {f.__name__: f for f in (asof_last_click, interval_clicks_before_sales, client_sessions)}
_CLICKS = "(SELECT click_id, m.ts AS ts, m.client_id AS client_id, m.kind AS kind FROM (SELECT click_id, first({'ts': ts, 'client_id': client_id, 'kind': kind} ORDER BY ts DESC NULLS LAST, client_id DESC NULLS LAST, kind DESC NULLS LAST) AS m FROM clicks WHERE click_id IS NOT NULL GROUP BY click_id) c)"
ORACLES = {
    "asof_last_click": lambda d: f"""WITH c AS (SELECT client_id, ts, first({{'click_id': click_id, 'kind': kind}} ORDER BY click_id DESC, kind DESC NULLS LAST) AS m FROM {_CLICKS} x WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY client_id, ts)
      SELECT sale_id, s.client_id, c.m.click_id AS click_id, c.m.kind AS kind FROM sales s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.ts""",
    "interval_clicks_before_sales": lambda d: f"SELECT sale_id, count(*) AS clicks, CAST(count_if(kind = 'purchase') AS BIGINT) AS purchases FROM sales s JOIN {_CLICKS} c ON s.client_id = c.client_id AND c.ts BETWEEN s.sold_at - INTERVAL 1 HOUR AND s.sold_at GROUP BY sale_id",
    "client_sessions": lambda d: f"""SELECT client_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {_CLICKS} c WHERE client_id IS NOT NULL AND ts IS NOT NULL) a) b GROUP BY client_id, session""",
}
