"""Operator 9: mix sources to target weights by Pareto order sampling, with DataFrame functions only.

Sizes are words. Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all words;
a source's target stops at ``most`` times its words, the excess going to the others by weight.
Of a source whose target is m times its words each document is taken floor(m) times for certain.
For the rest documents are ranked by random odds over inclusion odds and the first are taken, as
many as fit in the words that are missing; one closing document (all rows of it that share id and size), the one
that comes nearest to what is then still missing, ends the sample. Inclusion odds fall with the root of a document's length,
so one giant rarely decides a source.

Nothing is sorted by source: ranks are dealt into slices of their range, SLICES of them or one for each ROWS rows, whose
sums tell the slice that the cut lies in, and only that slice is ordered.

Defined cases: null text has no words; null source is a source of its own; a document without words
is taken zero times; rows that repeat a doc_id with the same size share their rank, and are taken
together or not at all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import table, written

SLICES, ROWS = 4096, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size (one row a source) -> with weight and target: water-filling in one pass over the sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    df = df.withColumn("ratio", most * F.col("source_size").cast("double") / F.col("weight"))
    df = df.select(
        "*",
        F.sum("source_size").over(everything).alias("words"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(most * F.sum("source_size").over(upto) - most * F.col("source_size"), F.lit(0)).alias("full_before"),
        (F.sum("weight").over(upto) - F.col("weight")).alias("weight_before"),
    )
    # source number k (by limit) stays below its limit if the level reached without it is below its ratio
    level = (F.col("words") - F.col("full_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    df = df.withColumn("open", level < F.col("ratio")).withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", F.col("full_before"), F.col("weight_before")))).over(everything))
    left = (F.col("words") - F.col("level.full_before")).cast("double")
    own = left * F.col("weight") / (F.col("weights") - F.col("level.weight_before"))
    limit = (most * F.col("source_size")).cast("double")
    return df.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level.ratio")), limit).otherwise(F.least(own, limit)).alias("target"))


def random_unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def mix(docs: DataFrame, most: int = 3, seed: int = 9) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized, _ = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    slices = max(SLICES, sized.count() // ROWS)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("with_words"))
    want = targets(totals.select("source", "source_size"), most)
    of = totals.select(F.col("source").alias("s"), "with_words")
    want = want.join(of, want["source"].eqNullSafe(of["s"])).select(F.col("source").alias("of"), "source_size", "target", "with_words")
    times = F.col("target") / F.col("source_size")
    want = want.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(times)).otherwise(F.lit(0)))
    want = want.withColumn("short", F.col("target") - F.col("copies") * F.col("source_size"))
    df = sized.join(want, sized["source"].eqNullSafe(want["of"])).drop("of")

    u = random_unit(F.col("doc_id"), seed)
    share = F.col("short") / F.col("source_size")
    odds = share / (F.lit(1.0) - share) * F.sqrt(F.col("source_size").cast("double") / F.col("with_words") / F.col("size"))
    df = df.withColumn("rank", F.when((F.col("size") > 0) & (F.col("short") > 0), u / (F.lit(1.0) - u) / odds))
    df = df.withColumn("slice", F.floor(F.col("rank") / (F.col("rank") + 1) * slices))
    ranked, _ = written(df, "ranked")

    in_order = Window.partitionBy("source").orderBy("slice")
    sums = ranked.where("slice is not null").groupBy("source", "slice", "short").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    cut = sums.where((F.col("before") <= F.col("short")) & (F.col("before") + F.col("words") > F.col("short"))).select(F.col("source").alias("of"), F.col("slice").alias("cut"), "before")
    df = ranked.join(cut, ranked["source"].eqNullSafe(cut["of"]), "left").drop("of")
    # without a cut every ranked document fits
    by_rank = Window.partitionBy("source").orderBy("rank", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.where(F.col("slice") == F.col("cut")).withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
    outside = df.where(F.col("slice").isNull() | F.col("cut").isNull() | (F.col("slice") != F.col("cut")))
    first = F.col("slice").isNotNull() & (F.col("cut").isNull() | (F.col("slice") < F.col("cut")))
    df = inside.withColumn("in", F.col("upto") <= F.col("short")).drop("upto").unionByName(outside.withColumn("in", F.coalesce(first, F.lit(False)))).drop("before", "cut")
    chosen, _ = written(df, "chosen")

    got = chosen.groupBy("source", "short").agg(F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("words")).select(F.col("source").alias("of"), (F.col("short") - F.col("words")).alias("missing"))
    open_ = chosen.where(~F.col("in") & F.col("rank").isNotNull()).join(got, chosen["source"].eqNullSafe(got["of"]))
    alike = open_.groupBy("of", "missing", "rank", "doc_id").agg(F.sum("size").alias("words"))
    off = F.abs(F.col("missing") - F.col("words"))
    last = alike.where(off < F.col("missing")).groupBy("of").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id")).alias("last"))
    df = chosen.join(last, chosen["source"].eqNullSafe(last["of"]), "left")
    closing = (F.col("rank") == F.col("last.rank")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id"))
    taken = F.col("size") * (F.col("copies") + (F.col("in") | F.coalesce(closing & ~F.col("in"), F.lit(False))).cast("int"))
    return df.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op9_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS with_words FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), limited AS (
  SELECT *, 3 * CAST(source_size AS DOUBLE) / weight AS ratio FROM weighed
), summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS words, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(3 * sum(source_size) OVER o - 3 * source_size AS BIGINT) AS full_before, CAST(sum(weight) OVER o - weight AS BIGINT) AS weight_before
  FROM limited WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT ratio, full_before, weight_before FROM summed
  WHERE CAST(words - full_before AS DOUBLE) / (weights - weight_before) < ratio ORDER BY 1, 2, 3 LIMIT 1
), want AS (
  SELECT s.source, s.source_size, s.with_words,
    CASE WHEN l.ratio IS NULL OR s.ratio < l.ratio THEN CAST(3 * s.source_size AS DOUBLE)
      ELSE least(CAST(s.words - l.full_before AS DOUBLE) * s.weight / (s.weights - l.weight_before), CAST(3 * s.source_size AS DOUBLE)) END AS target
  FROM summed s LEFT JOIN level l ON true
), copied AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM want
), short AS (
  SELECT *, target - copies * source_size AS short FROM copied
), joined AS (
  SELECT d.doc_id, d.size, s.*, (CAST(CAST('0x' || substr(md5('9:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN short s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, CASE WHEN size > 0 AND short > 0 THEN u / (1.0::DOUBLE - u) / (short / source_size / (1.0::DOUBLE - short / source_size) * sqrt(CAST(source_size AS DOUBLE) / with_words / size)) END AS rank FROM joined
), summed_up AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id RANGE UNBOUNDED PRECEDING) AS upto FROM ranked WHERE rank IS NOT NULL
), chosen AS (
  SELECT *, upto <= short AS taken_first FROM summed_up
), missing AS (
  SELECT *, short - sum(CASE WHEN taken_first THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing FROM chosen
), alike AS (
  SELECT source, missing, rank, doc_id, sum(size) AS words FROM missing WHERE NOT taken_first GROUP BY ALL
), closing AS (
  SELECT source, min(row(abs(missing - words), rank, doc_id)) AS last FROM alike WHERE abs(missing - words) < missing GROUP BY source
), sampled AS (
  SELECT m.doc_id, m.size, m.source_size, m.target,
    m.size * (m.copies + CASE WHEN m.taken_first OR (m.rank = c.last[2] AND m.doc_id IS NOT DISTINCT FROM c.last[3]) THEN 1 ELSE 0 END) AS taken
  FROM missing m LEFT JOIN closing c ON m.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM sampled
UNION ALL
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) FROM ranked WHERE rank IS NULL
"""
