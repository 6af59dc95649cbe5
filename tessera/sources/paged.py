"""Sources of a mailbox: a listing that is read page by page, and a history that is read after a cursor; Python data sources.

``listing`` (batch): every account is a partition, which follows its page tokens from the newest on; a token that comes again ends
it with an error, after ``max_pages`` pages it stops, and ids of the skip list are left out by the reader of the
rows (an anti join). ``history`` (stream): offsets are history numbers; a batch covers the numbers after the last
committed one up to the newest, at most ``cap``; its segments are read by tasks of their own. A run that is
started again reads from the committed offset, so that nothing is lost or told twice. A cursor that is older than the oldest
segment raises ``Expired``: its reader has to list anew.

Pages and segments lie in a folder that the executors share (any that pyarrow's file systems open); a service is put in its
place by another ``Folder``.

Defined cases: an account without pages gives no rows; a page that isn't there is empty and leads to the next older one; an empty
history gives no batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.published import workspace

SIZE, BLOCK, SEGMENT, PAGES = 20, 200, 1000, 5


class Expired(Exception):
    """The cursor is older than the history."""


class Folder:
    """Lines of JSON below a folder, by its subfolders."""

    def __init__(self, uri: str) -> None:
        self.system, self.root = fs.FileSystem.from_uri(uri)

    def names(self, path: str = "") -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{path}".rstrip("/"), allow_not_found=True))
        return [i.base_name for i in found if i.type == fs.FileType.Directory]

    def lines(self, path: str) -> Iterator[dict]:
        for info in self.system.get_file_info(fs.FileSelector(f"{self.root}/{path}", allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                with self.system.open_input_stream(info.path) as stream:
                    for line in stream.read().decode().splitlines():
                        yield json.loads(line)


class Account(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class ListingReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.pages = options["path"], int(options.get("maxPages", PAGES))

    def partitions(self) -> list[Account]:
        return [Account(n.removeprefix("account=")) for n in sorted(Folder(self.path).names())]

    def read(self, partition: Account | None) -> Iterator[tuple]:
        if partition is None:  # there are no accounts
            return
        folder, at = Folder(self.path), f"account={partition.name}"
        blocks = sorted(int(n.removeprefix("block=")) for n in folder.names(at))
        held: dict[int, dict[int, dict]] = {}

        def page(token: int) -> dict:
            block = token // BLOCK
            if block not in held:
                held.clear()
                held[block] = {p["token"]: p for p in folder.lines(f"{at}/block={block}")} if block in blocks else {}
            return held[block].get(token, {"ids": []})

        if not blocks:
            return
        token = max(p["token"] for p in folder.lines(f"{at}/block={blocks[-1]}"))
        seen: set[int] = set()
        while token is not None and len(seen) < self.pages:
            if token in seen:
                raise ValueError(f"page token {token} of {partition.name} came again")
            seen.add(token)
            found = page(token)
            for place, id_ in enumerate(found["ids"]):
                yield partition.name, len(seen) - 1, place, id_
            token = found.get("next", token - 1 if token else None)


class Listing(DataSource):
    """Options: path, maxPages."""

    @classmethod
    def name(cls) -> str:
        return "mail_listing"

    def schema(self) -> str:
        return "account string, page int, place int, id long"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class Span(InputPartition):
    def __init__(self, segment: int, after: int, upto: int) -> None:
        super().__init__(segment)
        self.segment, self.after, self.upto = segment, after, upto


class HistoryReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.cap = options["path"], int(options.get("cap", 1 << 62))
        self.start, self.told = int(options.get("after", -1)), None

    def initialOffset(self) -> dict:
        return {"seen": self.start}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        segments = sorted(int(n.removeprefix("segment=")) for n in folder.names())
        newest = max((r["number"] for r in folder.lines(f"segment={segments[-1]}")), default=self.start) if segments else self.start
        self.told = newest if self.told is None else min(newest, self.told + self.cap)
        return {"seen": self.told}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        after, upto = start["seen"], end["seen"]
        segments = sorted(int(n.removeprefix("segment=")) for n in Folder(self.path).names())
        if segments and after + 1 < segments[0] * SEGMENT:
            raise Expired(f"number {after + 1} is older than the history; list anew")
        return [Span(k, after, upto) for k in segments if k * SEGMENT <= upto and (k + 1) * SEGMENT > after + 1]

    def read(self, partition: Span) -> Iterator[tuple]:
        for r in Folder(self.path).lines(f"segment={partition.segment}"):
            if partition.after < r["number"] <= partition.upto:
                yield r["number"], r["account"], r["kind"]

    def commit(self, end: dict) -> None:
        self.told = end["seen"]


class History(DataSource):
    """Options: path, after (the cursor to begin with), cap."""

    @classmethod
    def name(cls) -> str:
        return "mail_history"

    def schema(self) -> str:
        return "number long, account long, kind string"

    def streamReader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def listed(spark: SparkSession, path: str, skip: DataFrame, pages: int = PAGES) -> DataFrame:
    """account, page, place, id of each account's newest pages, without the ids of skip (id)."""
    spark.dataSource.register(Listing)
    return spark.read.format("mail_listing").option("path", path).option("maxPages", pages).load().join(skip.select("id").distinct(), "id", "left_anti").select("account", "page", "place", "id")


def followed(spark: SparkSession, path: str, **options) -> DataFrame:
    """number, account, kind as a stream."""
    spark.dataSource.register(History)
    return spark.readStream.format("mail_history").option("path", path).options(**options).load()


def a2_paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: of each account (source) the five newest pages, newest first, without labelled messages, each with its detail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and source is not null")
    token = F.expr(f"doc_id div {SIZE}")
    pages = docs.groupBy(F.col("source").alias("account"), token.alias("token")).agg(F.sort_array(F.collect_list("doc_id"), False).alias("ids"))
    line = F.to_json(F.struct("token", "ids")).alias("value")
    path = workspace(spark, "listing")
    pages.select("account", F.expr(f"token div {BLOCK}").alias("block"), line).write.partitionBy("account", "block").text(path)
    rows = listed(spark, path, spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id")))
    detail = docs.select(F.col("doc_id").alias("of"), "n_chars")
    return rows.join(detail, rows["id"] == detail["of"]).select("account", F.col("page").cast("long").alias("page"), "id", "n_chars")


def a1_history_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the history after a cursor as a stream of its own source: a first run with half of the segments, a second from the committed offset with all."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null")
    line = F.to_json(F.struct(F.col("event_id").alias("number"), F.col("user_id").alias("account"), F.col("event_type").alias("kind"))).alias("value")
    lines = events.select(F.expr(f"event_id div {SEGMENT}").alias("segment"), F.col("event_id").alias("number"), line)
    root = workspace(spark, "history")
    half = events.agg(F.max("event_id").alias("n")).first()["n"]  # one number
    half = None if half is None else half // SEGMENT // 2
    for k in range(2):
        some = lines.where("false") if half is None else lines.where(F.col("segment") <= half if k == 0 else F.col("segment") > half)
        some.drop("number").write.mode("append").partitionBy("segment").text(f"{root}/lines")
        told = followed(spark, f"{root}/lines")
        told.writeStream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("number long, account long, kind string, batch int").parquet(f"{root}/out").drop("batch")


PLANS = {f.__name__: f for f in (a1_history_source, a2_paged_listing)}
ORACLES = {
    "a1_history_source": lambda d: "SELECT event_id AS number, user_id AS account, event_type AS kind FROM events WHERE event_id IS NOT NULL",
    "a2_paged_listing": lambda d: f"""SELECT source AS account, top - doc_id // {SIZE} AS page, doc_id AS id, n_chars FROM (SELECT *, max(doc_id // {SIZE}) OVER (PARTITION BY source) AS top FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL) d
      WHERE top - doc_id // {SIZE} < {PAGES} AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
}
