"""Search over any table: literal text, equalities, a half-open range, a stable order, pages with their total, rank fusion.

Defined cases: wildcards in the text are text; an empty or null text matches every row; null cells match no text and sort last;
a page beyond the end is empty and has no next one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, text: str | None = None, columns: Sequence[str] = ("text",), equal: Mapping[str, object] | None = None, over: str | None = None, since: object = None, until: object = None) -> DataFrame:
    """The rows that hold the text in any of the columns (case folded), have the values, and lie in [since, until) of the column ``over``."""
    where: list[Column] = []
    if text:
        held = [F.contains(F.lower(F.col(c)), F.lower(F.lit(text))) for c in columns]
        where.append(F.coalesce(F.greatest(*held) if len(held) > 1 else held[0], F.lit(False)))
    where += [F.col(c).eqNullSafe(F.lit(v)) for c, v in (equal or {}).items()]
    where += [F.col(over) >= F.lit(since)] if over and since is not None else []
    where += [F.col(over) < F.lit(until)] if over and until is not None else []
    for w in where:
        rows = rows.where(w)
    return rows


def page(rows: DataFrame, order: Sequence[Column], key: str, size: int = 20, number: int = 0) -> tuple[DataFrame, int, bool]:
    """The page, how many rows there are in all, and whether another page follows; ties go by key."""
    if not 1 <= size <= 200 or number < 0:
        raise ValueError("a page has 1 to 200 rows, pages begin at 0")
    total = rows.count()
    return rows.orderBy(*order, F.col(key)).offset(number * size).limit(size), total, total > (number + 1) * size


def fused(lexical: DataFrame, semantic: DataFrame, weight: float = 2.0, constant: int = 20, most: int = 20) -> DataFrame:
    """lexical (q, id, rank), semantic (q, id, rank, d) -> q, id, score, place: reciprocal ranks, the semantic one by nearness; ties by lexical rank, semantic rank, id."""
    left = lexical.select("q", "id", F.col("rank").alias("lex"))
    right = semantic.select("q", "id", F.col("rank").alias("sem"), "d")
    near = F.greatest(F.lit(0.0), 1 - F.col("d")) / (constant + F.col("sem"))
    score = F.round(F.coalesce(F.lit(weight) / (constant + F.col("lex")), F.lit(0.0)) + F.coalesce(near, F.lit(0.0)), 9)
    both = left.join(right, ["q", "id"], "full").withColumn("score", score)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("lex"), F.asc_nulls_last("sem"), "id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("q", "id", "score", "place")
