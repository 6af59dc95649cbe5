"""Written tables: the shared folder, tables published whole, schema versions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import Spark, plan


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or f"file://{tempfile.mkdtemp(prefix='tessera-')}").rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def json_lines(df: DataFrame, name: str) -> DataFrame:
    """The rows as JSON lines; the job's commit makes all files visible at its end or none. Nulls come back as nulls."""
    path = workspace(df.sparkSession, name)
    df.write.option("ignoreNullFields", False).json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def _rates(d: Spark) -> str:
    return f"SELECT substr({d.stamp('ts')}, 1, 16) AS minute, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2"


def a15_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a minute, published and read back."""
    return json_lines(plan(_rates)(spark, sf_dir), "rates")


#: What each version adds to a table, in order: column -> (type, the value of older rows).
VERSIONS = {"conversations": ({}, {"archived": ("boolean", "false")}, {"n_chars": ("bigint", "CAST(length(coalesce(text, '')) AS BIGINT)")}, {"label": ("string", "CASE WHEN turn = 0 THEN 'first' ELSE 'later' END")})}


def migrated(df: DataFrame, table: str, have: int) -> DataFrame:
    """The table at its newest version, in one projection. A newer version than known, or one whose columns are incomplete, is refused."""
    steps = VERSIONS[table]
    if not 1 <= have <= len(steps):
        raise ValueError(f"{table} is at version {have}, known are 1 to {len(steps)}")
    absent = [c for step in steps[:have] for c in step if c not in df.columns]
    if absent:
        raise ValueError(f"{table} at version {have} lacks {absent}")
    return df.select("*", *(F.expr(v).cast(t).alias(c) for step in steps[have:] for c, (t, v) in step.items()))


def a12_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first version to the newest."""
    return migrated(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conversations", 1).select("conv_id", "turn", "archived", "n_chars", "label")


def _migrated(d: Spark) -> str:
    return "SELECT conv_id, turn, " + ", ".join(f"{v} AS {c}" for step in VERSIONS["conversations"] for c, (_, v) in step.items()) + " FROM conversations"


PLANS = {"a15_json_lines": a15_json_lines, "a12_migrated": a12_migrated}
ORACLES = {"a15_json_lines": _rates, "a12_migrated": _migrated}
