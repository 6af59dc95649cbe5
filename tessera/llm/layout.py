"""Operator 11: a clustered layout over several dimensions, with exact cut values.

``cuts`` finds of each dimension the cells - 1 order statistics that part its rows into cells. Values are compared as
digits of up to 60 bits (longs: 2 of 32 bits; strings: 7 bytes each, with how many there are), and a digit is bisected by
counting: a round counts, in one job over the aggregated values, the rows in WAYS parts of each open interval, and keeps
the least and largest digit of the part that the rank lies in. So a round brings at most
dimensions * (cells - 1) * WAYS rows to the driver, whatever the input. ``placed`` compares each value with the cuts (a
binary search in the plan), interleaves the coordinates' bits to z, and sorts by (z, id) in one shuffle by ranges. What
follows needs only the cells, of which there are cells ** dimensions at most (CELLS is the bound): all rows of a file
inside one cell have that cell's coordinates, so file bounds, files that a query touches and files with matching rows
come from where the cells begin and end. ``stored`` writes the table itself in that order, as files of whole positions.

Defined cases: null is the smallest value of a dimension, and all equal values share a coordinate; null ids come first;
rows that share z and id follow each other by their values; an empty table gives an empty result; other columns don't
matter to ``op11_``, and go along in ``stored``, whatever their names but its own three.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.base import table, written

#: Parts of an interval that a round counts; rows of a file; most cells that a layout may have.
WAYS, ROWS, CELLS = 64, 2000, 1 << 16
#: Bytes of a string's digit; bits of it.
BYTES = 7


def _digits(kind: str) -> Callable[[Column, Column], Column]:
    """digit(value, its number) as a column."""
    if kind == "string":

        def digit(raw: Column, at: Column) -> Column:
            part = F.substring(raw, at * BYTES + 1, F.lit(BYTES))
            return F.conv(F.rpad(F.hex(part), 2 * BYTES, "0"), 16, 10).cast("long") * 16 + F.octet_length(part)

        return digit

    def digit(value: Column, at: Column) -> Column:
        return F.when(at == 0, F.shiftright(value, 32)).otherwise(value.bitwiseAND(F.lit(0xFFFFFFFF)))

    return digit


def _head(kind: str, head, digit: int):
    """What the digits up to this one tell of the value, and whether that is all of it."""
    if kind == "string":
        held = digit & 15
        return bytes(head) + (digit >> 4).to_bytes(BYTES, "big")[:held], held < BYTES
    return ((digit, False) if head is None else ((head << 32) | digit, True))


def cuts(values: DataFrame, kinds: dict[str, str], cells: int) -> dict[str, list]:
    """Per dimension (a column of values, of kind long or string) its order statistics number ceil(k * n / cells), k = 1 to cells - 1, by
    rounds of counting; strings as UTF-8 bytes, null as None. values without rows have no cuts."""
    spark, names = values.sparkSession, list(kinds)
    long_of = lambda c: F.col(c).cast("long") if kinds[c] == "long" else F.lit(None).cast("long")
    raw_of = lambda c: F.col(c).cast("binary") if kinds[c] == "string" else F.lit(None).cast("binary")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), long_of(c).alias("v"), raw_of(c).alias("raw")) for d, c in enumerate(names))))
    counted, _ = written(values.select(each.alias("x")).groupBy("x.dim", "x.v", "x.raw").agg(F.count(F.lit(1)).alias("n")), "counted")
    totals = {r["dim"]: (r["n"], r["nulls"]) for r in counted.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull() & F.col("raw").isNull(), F.col("n")).otherwise(0)).alias("nulls")).collect()}
    found: dict[tuple[int, int], object] = {}
    #: (dim, cut) -> head, number of the digit, its least and largest value (None: not known yet), rank among the rows that have the head and such a digit
    open_: dict[tuple[int, int], tuple] = {}
    for d, (n, nulls) in totals.items():
        for k in range(1, cells):
            rank = -(-k * n // cells)
            if rank <= nulls:
                found[d, k] = None
            else:
                open_[d, k] = (b"" if kinds[names[d]] == "string" else None, 0, None, None, rank - nulls)
    while open_:
        asked = {}  # interval -> its number
        for d, k in open_:
            asked.setdefault((d, *open_[d, k][:4]), len(asked))
        parts = _counted(spark, counted, kinds, names, asked)
        going = {}
        for (d, k), (head, at, lo, hi, rank) in open_.items():
            for least, most, n in parts[asked[d, head, at, lo, hi]]:
                if rank <= n:
                    break
                rank -= n
            kind = kinds[names[d]]
            if least < most:
                going[d, k] = (head, at, least, most, rank)
                continue
            head, whole = _head(kind, head, least)
            if whole:
                found[d, k] = head
            else:
                going[d, k] = (head, at + 1, None, None, rank)
        open_ = going
    return {c: [found[d, k] for k in range(1, cells)] if d in totals else [] for d, c in enumerate(names)}


def _counted(spark: SparkSession, counted: DataFrame, kinds: dict[str, str], names: list[str], asked: dict) -> dict[int, list[tuple[int, int, int]]]:
    """Of each interval its parts that have rows, in order: least digit, largest digit, rows. An interval whose ends aren't known is one part."""
    rows = []
    for (d, head, at, lo, hi), number in asked.items():
        text = kinds[names[d]] == "string"
        width = -(-(hi - lo + 1) // WAYS) if lo is not None else None
        rows.append((d, number, at, bytearray(head) if text else None, None if text else head, lo, hi, width))
    kind = [("of", IntegerType()), ("number", IntegerType()), ("at", IntegerType()), ("head", BinaryType()), ("high", LongType()), ("lo", LongType()), ("hi", LongType()), ("width", LongType())]
    intervals = spark.createDataFrame(rows, StructType([StructField(n, t) for n, t in kind]))
    df = counted.where(F.col("v").isNotNull() | F.col("raw").isNotNull()).join(F.broadcast(intervals), F.col("dim") == F.col("of"))
    begins = F.coalesce(F.substring(F.col("raw"), F.lit(1), F.col("at") * BYTES) == F.col("head"), F.lit(False))
    above = (F.col("at") == 0) | F.coalesce(_digits("long")(F.col("v"), F.lit(0)) == F.col("high"), F.lit(False))
    df = df.where(F.when(F.col("raw").isNotNull(), begins).otherwise(above))
    digit = F.when(F.col("raw").isNotNull(), _digits("string")(F.col("raw"), F.col("at"))).otherwise(_digits("long")(F.col("v"), F.col("at")))
    df = df.withColumn("digit", digit).where(F.col("lo").isNull() | F.col("digit").between(F.col("lo"), F.col("hi")))
    part = F.coalesce(F.expr("(digit - lo) div width"), F.lit(0))
    df = df.groupBy("number", part.alias("part")).agg(F.min("digit").alias("least"), F.max("digit").alias("most"), F.sum("n").alias("n"))
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["number"], r["part"])):
        out.setdefault(r["number"], []).append((r["least"], r["most"], r["n"]))
    return out


def coordinate(value: Column, at: Sequence, kind: str) -> Column:
    """How many of the cuts (in order) are smaller than the value, by binary search."""
    plain = value.cast("binary") if kind == "string" else value

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        less = F.lit(True) if at[mid] is None else F.lit(bytearray(at[mid]) if kind == "string" else at[mid]) < plain
        return F.when(less, search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(value.isNull(), 0).otherwise(search(0, len(at))).cast("int")


def interleaved(coordinates: Sequence[Column], cells: int) -> Column:
    """The coordinates' binary digits in turn, highest first, the first coordinate's first in each round."""
    z, bits = F.lit(0).cast("long"), max(1, (cells - 1).bit_length())
    for b in reversed(range(bits)):
        for c in coordinates:
            z = z * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1))
    return z


def placed(df: DataFrame, id_: str, kinds: dict[str, str], rounds: Sequence[str], cells: int = 8, rows: int = ROWS) -> DataFrame:
    """df (id_, the dimensions) -> id_, c_<dimension> ..., z, position, file: one row each, in a written table. rounds: the dimensions as their bits take turns in z."""
    if cells ** len(kinds) > CELLS:
        raise ValueError(f"{cells} cells in {len(kinds)} dimensions are more than {CELLS}")
    keys, _ = written(df.select(F.col(id_).alias("id"), *(F.col(c).alias(f"v_{c}") for c in kinds)), "keys")
    at = cuts(keys, {f"v_{c}": k for c, k in kinds.items()}, cells)
    coded = keys.select("*", *(coordinate(F.col(f"v_{c}"), at[f"v_{c}"], k).alias(f"c_{c}") for c, k in kinds.items()))
    coded = coded.withColumn("z", interleaved([F.col(f"c_{c}") for c in rounds], cells))
    order = ["z", "id", *(f"v_{c}" for c in kinds)]
    # the number within a sorted part: part << 33 | row
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("id", *(f"c_{c}" for c in kinds), "z", F.monotonically_increasing_id().alias("at"))
    ordered, _ = written(ordered, "ordered")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a part, of which there are spark.sql.shuffle.partitions
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    df = ordered.withColumn("part", part).join(F.broadcast(parts), "part")
    df = df.withColumn("position", F.col("before") + row)
    return df.select(F.col("id").alias(id_), *(f"c_{c}" for c in kinds), "z", "position", F.expr(f"position div {rows}").alias("file"))


def cells_of(laid: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row a cell that has rows: z, c_<dimension> ..., its first and last file."""
    return laid.groupBy("z", *(f"c_{c}" for c in dims)).agg(F.min("file").alias("first"), F.max("file").alias("last"))


def bounds_of(cells: DataFrame, dims: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Files at a cell's ends: file, lo_<d>, hi_<d> ...; and of cells with files between these: how many (files), the same bounds.

    A file that holds more than one cell is the first or last of each, so its bounds come from its cells; one between a
    cell's first and last file holds that cell alone."""
    ends = cells.select("*", F.explode(F.array_distinct(F.array("first", "last"))).alias("file"))
    mixed = ends.groupBy("file").agg(*(f(f"c_{c}").alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))))
    inner = cells.where(F.col("last") - F.col("first") > 1).select("z", (F.col("last") - F.col("first") - 1).alias("files"), *(F.col(f"c_{c}").alias(f"{n}_{c}") for c in dims for n in ("lo", "hi")))
    return mixed, inner


def touched(cells: DataFrame, dims: dict[str, int], most: int) -> DataFrame:
    """For each cell the query around it (per dimension coordinates at most dims[d] away): z, files_touched (whose bounds meet the query),
    files_matching (that hold a row inside it). most: the largest coordinate. All over cells, not over rows or files."""
    mixed, inner = bounds_of(cells, dims)
    box = [f"{n}_{c}" for c in dims for n in ("lo", "hi")]
    boxes = mixed.select(F.lit(1).cast("long").alias("files"), *box).unionByName(inner.select("files", *box)).groupBy(*box).agg(F.sum("files").alias("files"))
    for c, far in dims.items():
        boxes = boxes.withColumn(f"c_{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"lo_{c}") - far), F.least(F.lit(most), F.col(f"hi_{c}") + far))))
    met = boxes.groupBy(*(f"c_{c}" for c in dims)).agg(F.sum("files").alias("files_touched"))
    # runs of files that neighbours hold, merged: the union of a few intervals each
    near = cells.select("first", "last", *(F.col(f"c_{c}").alias(f"o_{c}") for c in dims))
    for c, far in dims.items():
        near = near.withColumn(f"c_{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"o_{c}") - far), F.least(F.lit(most), F.col(f"o_{c}") + far))))
    where = [f"c_{c}" for c in dims]
    before = Window.partitionBy(*where).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("last") - F.greatest(F.col("first"), F.coalesce(F.max("last").over(before) + 1, F.col("first"))) + 1
    held = near.select(*where, F.greatest(new, F.lit(0)).alias("new")).groupBy(*where).agg(F.sum("new").alias("files_matching"))
    return cells.join(met, where).join(held, where).select("z", "files_touched", "files_matching")


def stored(df: DataFrame, path: str, id_: str, kinds: dict[str, str], rounds: Sequence[str], cells: int = 8, rows: int = ROWS) -> DataFrame:
    """df itself, laid out: Parquet under path by ranges of z and id, sorted, with z, position and file as further columns; ids are distinct and not null."""
    laid = placed(df, id_, kinds, rounds, cells, rows).select(F.col(id_).alias("_laid"), "z", "position", "file")
    out = df.join(laid, df[id_] == laid["_laid"]).drop("_laid").repartitionByRange("position").sortWithinPartitions("position")
    out.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


#: The dimensions of a document, as they are given in file_bounds: kind, how far a query reaches, and their turn in z.
DOCUMENT = {"source": ("string", 0), "lang": ("string", 0), "length": ("long", 1), "date": ("long", 1)}
ROUNDS = ("date", "length", "lang", "source")


def document_values(docs: DataFrame) -> DataFrame:
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    return docs.select("doc_id", "source", "lang", length.alias("length"), (F.crc32(F.col("doc_id").cast("string")) % 365).alias("date"))


def clustered(docs: DataFrame, cells: int = 8, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, z, position, file, files_touched, files_matching, file_bounds, and the four coordinates."""
    dims = list(DOCUMENT)
    laid, _ = written(placed(document_values(docs), "doc_id", {c: k for c, (k, _) in DOCUMENT.items()}, ROUNDS, cells, rows), "laid")
    grid, _ = written(cells_of(laid, dims), "cells")
    answers = touched(grid, {c: far for c, (_, far) in DOCUMENT.items()}, cells - 1)
    mixed, _ = bounds_of(grid, dims)
    edge = F.concat_ws(",", *(f"{n}_{c}" for c in dims for n in ("lo", "hi")))
    own = F.concat_ws(",", *(f"c_{c}" for c in dims for _ in range(2)))
    # both sides are bounded by the cells: an answer each, two files each at most
    df = laid.join(F.broadcast(answers), "z").join(F.broadcast(mixed.select("file", edge.alias("edge"))), "file", "left")
    return df.select("doc_id", "z", "position", "file", "files_touched", "files_matching", F.coalesce("edge", own).alias("file_bounds"), *(f"c_{c}" for c in dims))


def op11_counting_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents"))


#: crc32 of a text t in DuckDB, which has none: by the table of 256 remainders.
REMAINDERS = "(SELECT list(r ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b) x) y)"


def crc32(t: str, remainders: str) -> str:
    held = f"list_transform(range(1, strlen({t}) + 1), lambda i: CAST('0x' || substr(hex({t}), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {held}), lambda c, b: xor(c >> 8, {remainders}[(xor(c, b) & 255) + 1])), 4294967295)"


def _oracle() -> str:
    cell = lambda c: f"(8 * (rank() OVER (ORDER BY {c} NULLS FIRST) - 1)) // count(*) OVER () AS c_{c}"
    bit = lambda c, b: f"(c_{c} >> {b}) & 1"
    z = "0"
    for b in (2, 1, 0):
        for c in ROUNDS:
            z = f"({z}) * 2 + ({bit(c, b)})"
    dims = list(DOCUMENT)
    meets = " AND ".join(f"f.lo_{c} <= q.c_{c} + {far} AND f.hi_{c} >= q.c_{c} - {far}" for c, (_, far) in DOCUMENT.items())
    inside = " AND ".join(f"r.c_{c} BETWEEN q.c_{c} - {far} AND q.c_{c} + {far}" for c, (_, far) in DOCUMENT.items())
    each = ", ".join(f"c_{c}" for c in dims)
    return f"""
WITH keys AS (
  SELECT doc_id, source, lang, CAST(coalesce(strlen(text), -1) AS BIGINT) AS length, {crc32("t", "k")} % 365 AS date
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS t, {REMAINDERS} AS k FROM documents) d
), coded AS (SELECT *, {", ".join(cell(c) for c in dims)} FROM keys
), numbered AS (SELECT *, CAST({z} AS BIGINT) AS z FROM coded
), placed AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM numbered
), laid AS (SELECT *, position // 2000 AS file FROM placed
), files AS (SELECT file, {", ".join(f"min(c_{c}) AS lo_{c}, max(c_{c}) AS hi_{c}" for c in dims)} FROM laid GROUP BY file
), cells AS (SELECT DISTINCT {each} FROM laid
), held AS (SELECT DISTINCT file, {each} FROM laid
), touched AS (SELECT {", ".join(f"q.c_{c}" for c in dims)}, count(*) AS files_touched FROM cells q JOIN files f ON {meets} GROUP BY ALL
), matching AS (SELECT {", ".join(f"q.c_{c}" for c in dims)}, count(DISTINCT r.file) AS files_matching FROM cells q JOIN held r ON {inside} GROUP BY ALL
)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', {", ".join(f"lo_{c}, hi_{c}" for c in dims)}) AS file_bounds, {", ".join(f"CAST(c_{c} AS INTEGER) AS c_{c}" for c in dims)}
FROM laid JOIN files USING (file) JOIN touched USING ({each}) JOIN matching USING ({each})
"""


ORACLE = _oracle()
