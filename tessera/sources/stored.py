"""Stored tables that are merged by key: parts by key hash, revisions, and commits that refuse a stale writer.

A table is a folder of parts (rows of equal key hash) and one small commit file a revision, which says for each part where its
rows are. A merge reads and writes only the parts that its keys fall in, by partition pruning, and then creates the next
revision's file; who finds it there already was overtaken and gets ``Conflict``, with nothing changed. Readers see a whole
revision, old or new; earlier ones can still be read. What a merge makes of a row is given by expressions over ``old`` and
``new``, so that each kind of upsert is a dictionary: replaced, coalesced, kept if corrected, kept if looked at.

Defined cases: keys are not null (such rows are refused); updates have each key once; a key without an old row is new, one without
a new row stays as it is; a merge without rows commits nothing; rows for which ``keep`` is not true go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.published import workspace


class Conflict(Exception):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def revision(spark: SparkSession, path: str) -> int:
    """The newest revision, -1 if there is none."""
    fs, at = _fs(spark, f"{path}/commits")
    return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else -1


def _commit(spark: SparkSession, path: str, number: int, state: Mapping) -> None:
    fs, at = _fs(spark, f"{path}/commits/{number}")
    if fs.exists(at):
        raise Conflict(f"{path} has a revision {number} already")
    try:
        out = fs.create(at, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path} has a revision {number} already") from error
        raise
    out.write(json.dumps(state).encode())
    out.close()


def _state(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/commits/{number}").collect()))


def _written(df: DataFrame, path: str, key: str, parts: int) -> str:
    where = f"{path}/rows/{uuid.uuid4().hex}"
    df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy("_part").parquet(where)
    return where


def created(df: DataFrame, path: str, key: str, parts: int = 16) -> int:
    """df (key: each once) as revision 0."""
    if not df.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null")
    where = _written(df, path, key, parts)
    spark = df.sparkSession
    _commit(spark, path, 0, {"key": key, "parts": parts, "schema": df.schema.json(), "rows": {str(k): where for k in range(parts)}})
    return 0


def read(spark: SparkSession, path: str, number: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows of a revision (the newest), of all parts or only some."""
    from pyspark.sql.types import LongType, StructType

    state = _state(spark, path, revision(spark, path) if number is None else number)
    schema = StructType.fromJson(json.loads(state["schema"]))
    places: dict[str, list[int]] = {}
    for k, where in state["rows"].items():
        if only is None or int(k) in only:
            places.setdefault(where, []).append(int(k))
    out = spark.createDataFrame([], schema)
    # a folder of rows is written by one merge: as many as parts at most
    for where, ks in places.items():
        out = out.unionByName(spark.read.schema(StructType(schema.fields).add("_part", LongType())).parquet(where).where(F.col("_part").isin(ks)).drop("_part"))
    return out


def merge(updates: DataFrame, path: str, rules: Mapping[str, str], expected: int, keep: str = "true") -> int:
    """Merge updates (key once a row) into revision ``expected`` and return the new one. rules: column -> SQL over old.*, new.* (a side without a row is null, and so is its struct)."""
    spark = updates.sparkSession
    state = _state(spark, path, expected)
    key, parts = state["key"], state["parts"]
    at = workspace(spark, "updates")
    updates.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).write.parquet(at)
    rows = spark.read.parquet(at)
    touched = {r["_part"] for r in rows.select("_part").distinct().collect()}  # as many as parts at most
    if not touched:
        return expected
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null")
    old = read(spark, path, expected, touched)
    a, b = old.select(F.struct("*").alias("old")), rows.drop("_part").select(F.struct("*").alias("new"))
    both = a.join(b, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    made = [F.coalesce(f"new.{key}", f"old.{key}").alias(key) if f.name == key else F.when(F.col("new").isNull(), F.col(f"old.{f.name}")).otherwise(F.expr(rules.get(f.name, f"new.{f.name}"))).cast(f.dataType).alias(f.name) for f in old.schema.fields]
    where = _written(both.select(made).where(keep), path, key, parts)
    _commit(spark, path, expected + 1, state | {"rows": state["rows"] | {str(k): where for k in touched}})
    return expected + 1


#: Upserts as rules. A replacement keeps when a row was made; a coalescing one what it knew; a score when it was looked at; a
#: correction stands against updates, of which only others count a revision.
REPLACED = {"created_at": "coalesce(old.created_at, new.created_at)"}
LEDGER = {
    "amount": "CASE WHEN old.user_corrected THEN old.amount ELSE new.amount END",
    "user_corrected": "coalesce(old.user_corrected, new.user_corrected)",
    "revision": "CASE WHEN old.revision IS NULL THEN new.revision WHEN old.user_corrected THEN old.revision ELSE old.revision + 1 END",
}
SCORES = {"reviewed": "old.reviewed"}
#: A change is taken if its number is newer than the row's; where it is known best is kept from either.
CHANGES = {
    "segment": "CASE WHEN old.seq >= new.seq THEN old.segment ELSE new.segment END",
    "city": "CASE WHEN old.seq >= new.seq THEN coalesce(old.city, new.city) ELSE coalesce(new.city, old.city) END",
    "gone": "CASE WHEN old.seq >= new.seq THEN old.gone ELSE new.gone END",
    "first_at": "least(old.first_at, new.first_at)",
    "seq": "greatest(old.seq, new.seq)",
    "n": "coalesce(old.n, 0) + new.n",
}


def k9_ledger_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the orders' amounts as a stored ledger, every fifth corrected by its user; an update of most of them, merged."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey is not null").select(F.col("o_orderkey").alias("id"), F.expr("CAST(round(o_totalprice * 100) AS BIGINT)").alias("amount"))
    path = workspace(spark, "ledger")
    base = orders.where("id % 3 <> 0").select("id", "amount", F.expr("id % 5 = 0").alias("user_corrected"), F.lit(1).cast("long").alias("revision"))
    new = orders.where("id % 4 <> 1").select("id", (F.col("amount") + 1).alias("amount"), F.lit(False).alias("user_corrected"), F.lit(1).cast("long").alias("revision"))
    merge(new, path, LEDGER, created(base, path, "id"))
    return read(spark, path)


def l6_scores_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents, merged; when one was looked at stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    path = workspace(spark, "scores")
    base = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.expr("n_chars % 101").alias("score"), F.expr("doc_id % 4 = 0").alias("reviewed"))
    new = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.expr("CAST(length(coalesce(text, '')) % 89 AS BIGINT)").alias("score"), F.lit(None).cast("boolean").alias("reviewed"))
    merge(new, path, SCORES, created(base, path, "id"))
    return read(spark, path)


def n3_client_changes_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients' changes merged in three batches of their numbers, newest first, so that late ones come last; repeated changes count once, clients that were deleted last go."""
    rows = spark.read.parquet(f"{sf_dir}/client_changes.parquet").where("client_id is not null and seq is not null").dropDuplicates(["change_id"])
    at = F.struct("seq", "change_id")
    known = F.max(F.when(F.col("city").isNotNull(), F.struct("seq", "change_id", "city")))
    last = F.max(F.struct("seq", "change_id", "segment", "op"))

    def folded(some: DataFrame) -> DataFrame:
        df = some.groupBy("client_id").agg(last.alias("l"), known.alias("k"), F.min("valid_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
        return df.select("client_id", "l.seq", "l.segment", F.col("k.city").alias("city"), (F.col("l.op") == "D").alias("gone"), "first_at", "n")

    path = workspace(spark, "clients")
    number = created(folded(rows.where("seq >= 12")), path, "client_id")
    for some in ("seq >= 4 and seq < 12", "seq < 4"):
        number = merge(folded(rows.where(some)), path, CHANGES, number)
    return read(spark, path).where("gone is not true").drop("gone")


PLANS = {f.__name__: f for f in (k9_ledger_stored, l6_scores_stored, n3_client_changes_stored)}
_LEDGER = "SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders WHERE o_orderkey IS NOT NULL"
ORACLES = {
    "k9_ledger_stored": lambda d: f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id % 5 = 0 OR b.id IS NULL THEN a.amount ELSE b.amount + 1 END AS amount, coalesce(a.id % 5 = 0, false) AS user_corrected, CASE WHEN a.id IS NULL OR b.id IS NULL OR a.id % 5 = 0 THEN 1::BIGINT ELSE 2 END AS revision
      FROM (SELECT * FROM ({_LEDGER}) x WHERE id % 3 <> 0) a FULL JOIN (SELECT * FROM ({_LEDGER}) y WHERE id % 4 <> 1) b ON a.id = b.id""",
    "l6_scores_stored": lambda d: """SELECT coalesce(n.id, o.id) AS id, coalesce(n.score, o.score) AS score, o.reviewed FROM (SELECT doc_id AS id, n_chars % 101 AS score, doc_id % 4 = 0 AS reviewed FROM documents WHERE doc_id % 3 <> 0) o
      FULL JOIN (SELECT doc_id AS id, CAST(length(coalesce(text, '')) % 89 AS BIGINT) AS score FROM documents WHERE doc_id % 5 <> 0) n ON n.id = o.id""",
    "n3_client_changes_stored": lambda d: """SELECT client_id, seq, segment, city, first_at, n FROM (
      SELECT client_id, max(seq) AS seq, first(segment ORDER BY seq DESC, change_id DESC) AS segment, first(city ORDER BY seq DESC, change_id DESC) FILTER (WHERE city IS NOT NULL) AS city, min(valid_at) AS first_at, count(*) AS n, first(op ORDER BY seq DESC, change_id DESC) AS op
      FROM (SELECT DISTINCT ON (change_id) * FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL) c GROUP BY client_id) x WHERE op IS DISTINCT FROM 'D'""",
}
