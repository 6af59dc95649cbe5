"""Recorded rows as files: JSON, JSON lines and CSV read into tables, CSV, report and outbox written and read back.

Defined cases: a line that is no record has nulls and is counted out; of one key the last line stands; labels that no mapping
knows are refused, not guessed; cells that a spreadsheet would run begin with a quote mark; nulls are empty cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.published import workspace

LABELS = {"click": "ROUTINE", "view": "ROUTINE", "purchase": "IMPORTANT", "signup": "IMPORTANT", "error": "SPAM"}


def json_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold arrays of cases."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def recorded(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines; broken lines are left out, of one key the last (by a column of the lines) stands. A line is read as a list of one object, so that what follows the object breaks it too."""
    read = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in schema.split(', ')))}>>")
    rows = spark.read.text(path).select(read.alias("rows")).where("size(rows) = 1").select(F.inline("rows")).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def aligned(rows: DataFrame, column: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their labels mapped, and those that are refused."""
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    mapped = rows.withColumn("label", F.try_element_at(known, F.col(column)))
    return mapped.where("label is not null"), mapped.where("label is null")


def cell(c: Column) -> Column:
    """Text that a spreadsheet takes as text."""
    return F.when(c.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_export(df: DataFrame, name: str) -> str:
    """All columns as escaped text, with a header, published whole; the folder."""
    path = workspace(df.sparkSession, name)
    df.select(*(cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def a13_json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an array of ten thousand cases each, written as JSON and read with their nested parts."""
    path = workspace(spark, "cases")
    case = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("expected"), F.from_json("props", "k int").alias("explanation"))
    chunk = F.expr("event_id div 10000").alias("chunk")
    _events(spark, sf_dir).groupBy(chunk).agg(F.to_json(F.collect_list(case)).alias("value")).write.partitionBy("chunk").text(path)
    return json_cases(spark, path, "id long, expected string, explanation struct<k:int>").select("id", "expected", F.col("explanation.k").cast("long").alias("k"))


def a13_last_line_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers as JSON lines with broken lines among them, the last of a user."""
    path = workspace(spark, "lines")
    line = F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_id").alias("line"), F.col("event_type").alias("answer")))
    _events(spark, sf_dir).select(F.when(F.col("event_id") % 11 == 0, F.concat(line, F.lit(" {"))).when(F.col("event_id") % 13 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return recorded(spark, path, "id long, line long, answer string", "id", "line").select("id", "line", "answer")


def a16_align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign labels read from CSV, mapped, unknown ones refused."""
    foreign = F.when(F.col("event_id") % 17 == 0, "eggs").otherwise(F.col("event_type"))
    path = csv_export(_events(spark, sf_dir).select(F.col("event_id").alias("id"), foreign.alias("foreign")), "foreign")
    good, bad = aligned(read_csv(spark, path, "id long, foreign string"), "foreign", LABELS)
    return good.select("id", "label", F.lit(False).alias("refused")).unionByName(bad.select("id", "label", F.lit(True).alias("refused")))


def a17_formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked messages as CSV, read back cell by cell."""
    from tessera.plans.dialect import SPARK, plan
    from tessera.plans.messages import messages
    from tessera.plans.money import redacted

    rows = plan(lambda d: f"SELECT id, {_sheet(d)} AS note, {redacted(SPARK, 'subject')} AS subject FROM {messages(d)} m")(spark, sf_dir)
    return read_csv(spark, csv_export(rows, "export"), "id long, note string, subject string").select("id", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("subject", F.lit("")).alias("subject"))


def _sheet(d) -> str:
    return "CASE id % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN '-x' WHEN 2 THEN '@a' WHEN 3 THEN 'plain, \"quoted\"' ELSE '' END"


def _exported(d) -> str:
    from tessera.plans.messages import messages
    from tessera.plans.money import redacted

    safe = lambda c: f"CASE WHEN {d.like(c, '^[=+@-]')} THEN concat(chr(39), {c}) ELSE {c} END"
    return f"SELECT id, {safe('note')} AS note, {safe('s')} AS subject FROM (SELECT id, {_sheet(d)} AS note, {redacted(d, 'subject')} AS s FROM {messages(d)} m) x"


def a18_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as Markdown in one file, ordered, the same at every run; its lines."""
    rows = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"))
    lines = rows.select(F.concat(F.lit("| "), "event_type", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("u").cast("string"), F.lit(" |")).alias("line"), F.col("event_type").alias("at"))
    head = spark.createDataFrame([("| kind | events | users |", "0"), ("|-|-:|-:|", "1")], "line string, at string")
    path = workspace(spark, "report")
    head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("line").write.text(path)  # a line a kind
    return spark.read.text(path).select(F.col("value").alias("line"))


def a19_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due reminders queue for a channel, go out as JSON lines, and what was written is told from what waits."""
    events = _events(spark, sf_dir)
    due = events.where("event_type = 'error'").select("event_id", "user_id", F.lit("dashboard").alias("channel"))
    path = workspace(spark, "outbox")
    due.where("event_id % 4 <> 0").write.json(path)
    sent = spark.read.schema(due.schema).json(path).select("event_id", F.lit(True).alias("sent"))
    return due.join(sent, "event_id", "left").select("event_id", "channel", F.coalesce("sent", F.lit(False)).alias("sent"))


PLANS = {f.__name__: f for f in (a13_json_cases, a13_last_line_wins, a16_align_labels, a17_formula_escape, a18_report_lines, a19_outbox)}
_LABEL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS.items()) + " END"
ORACLES = {
    "a13_json_cases": lambda d: "SELECT event_id AS id, event_type AS expected, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "a13_last_line_wins": lambda d: "SELECT user_id AS id, max(event_id) AS line, arg_max(event_type, event_id) AS answer FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY user_id",
    "a16_align_labels": lambda d: f"SELECT event_id AS id, CASE WHEN event_id % 17 <> 0 THEN {_LABEL} END AS label, event_id % 17 = 0 OR {_LABEL} IS NULL AS refused FROM events",
    "a17_formula_escape": _exported,
    "a18_report_lines": lambda d: "SELECT '| ' || event_type || ' | ' || CAST(count(*) AS STRING) || ' | ' || CAST(count(DISTINCT user_id) AS STRING) || ' |' AS line FROM events GROUP BY event_type UNION ALL SELECT '| kind | events | users |' UNION ALL SELECT '|-|-:|-:|'",
    "a19_outbox": lambda d: "SELECT event_id, 'dashboard' AS channel, event_id % 4 <> 0 AS sent FROM events WHERE event_type = 'error'",
}
