"""Phrases in texts where both sides are large: postings of each phrase's rarest seed, texts only for candidates.

A phrase's inner words stand whole in a text that holds it, so its seeds are the runs of up to four inner words, by hash.
Texts give postings (seed, id) of those seeds alone that some phrase has, once a text; by their counts each phrase keeps its
rarest seed, whose postings are its candidates. Phrases of one or two words have no inner word: their longer word
is looked for inside the distinct words of all texts (by the rarest of its runs of GRAM letters), and the words found
give the candidates. Only candidates meet the texts, by id, where the phrase is looked up letter by letter; so no
row of a seed or a word carries a text, and nothing is compared all against all.

Defined cases: phrases and texts are normalised alike, with single spaces; null or empty phrases and null texts match
nothing; a phrase is a substring, so its first and last word may be parts of words; repeated phrases and ids count each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.cells import saved
from tessera.plans.dialect import SPARK
from tessera.plans.texts import key, quoted

#: Words of a seed; letters of a run.
SEED, GRAM = 4, 3


def _seeds(words: Column, size: int, first: int, dropped: int) -> Column:
    """Hashes of the runs of ``size`` words, from number ``first`` (0: the first word), without the last ``dropped``."""
    runs = F.size(words) - size + 1 - first - dropped
    # the array beside itself, moved by one word each time: one pass, however long the text
    beside = F.arrays_zip(*(F.slice(words, first + 1 + k, runs) for k in range(size)))
    hashed = F.transform(beside, lambda x: F.xxhash64(*(x[str(k)] for k in range(size))))
    return F.when(runs > 0, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def _rarest(seeds: DataFrame, postings: DataFrame, owner: str, seed: str) -> DataFrame:
    """seeds (owner, seed), postings (seed, ...) -> of each owner all of whose seeds have postings the seed of fewest."""
    counts = postings.groupBy(seed).agg(F.count(F.lit(1)).alias("n"))
    each = seeds.join(counts, seed, "left")
    return each.groupBy(owner).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(seed))).alias("m")).where("m.n > 0").select(owner, F.col(f"m.{seed}").alias(seed))


def _runs(word: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, F.lit(size))))


def found(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """docs (id, s), phrases (pid, q) -> pid, id of every text that holds a phrase, once a pair of rows."""
    own = phrases.where("q <> ''").select("q").distinct().withColumn("ws", F.split("q", " ")).withColumn("n", F.size("ws"))
    own = saved(own.withColumn("size", F.least(F.lit(SEED), F.col("n") - 2)), "phrases")
    texts = docs.where("s is not null").select("id", "s")
    candidates = []
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # SEED + 2 different ones at most
    for size in (k for k in sizes if k >= 1):
        seeds = saved(own.where(F.col("size") == size).select("q", F.explode(_seeds(F.col("ws"), size, 1, 1)).alias("seed")), "seeds")
        wanted = seeds.select("seed").distinct()
        postings = texts.select("id", F.explode(_seeds(F.split("s", " "), size, 0, 0)).alias("seed"))
        postings = saved(postings.join(wanted, "seed", "left_semi"), "postings")
        candidates.append(_rarest(seeds, postings, "q", "seed").join(postings, "seed").select("q", "id"))
    if any(k < 1 for k in sizes):
        short = own.where("size < 1").select("q", F.when((F.col("n") == 2) & (F.length(F.element_at("ws", -1)) > F.length(F.element_at("ws", 1))), F.element_at("ws", -1)).otherwise(F.element_at("ws", 1)).alias("w"))
        postings = saved(texts.select("id", F.explode(F.array_distinct(F.split("s", " "))).alias("word")), "words")
        vocabulary = saved(postings.select("word").distinct(), "vocabulary")
        for size in range(1, GRAM + 1):
            some = short.where(F.least(F.length("w"), F.lit(GRAM)) == size).where("w <> ''")
            if some.isEmpty():
                continue
            runs = saved(some.select("q", "w", F.explode(_runs(F.col("w"), size)).alias("run")), "runs")
            inside = vocabulary.where(F.length("word") >= size).select("word", F.explode(_runs(F.col("word"), size)).alias("run"))
            inside = saved(inside.join(runs.select("run").distinct(), "run", "left_semi"), "inside")
            named = _rarest(runs.select("q", "run"), inside, "q", "run").join(some, "q").join(inside, "run").where(F.expr("contains(word, w)")).select("q", "word")
            candidates.append(named.join(postings, "word").select("q", "id").distinct())
    if not candidates:
        return phrases.select("pid").limit(0).crossJoin(docs.select("id").limit(0))
    pairs = reduce(DataFrame.unionByName, candidates).withColumnRenamed("id", "of")
    held = texts.join(pairs, texts["id"].eqNullSafe(pairs["of"])).where(F.expr("contains(s, q)")).select("q", "id")
    return phrases.select("pid", "q").join(held, "q").select("pid", "id")


def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: in how many documents each item stands word for word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.expr(key(SPARK, "text")).alias("s"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pid"), F.expr(quoted(SPARK, "text")).alias("q"))
    hits = found(docs, items).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "pid", "left").select(F.col("pid").alias("item_id"), F.coalesce("n", F.lit(0)).alias("documents"))


PLANS = {"grounded_quotes": grounded_quotes}
ORACLES = {
    "grounded_quotes": lambda d: f"SELECT b.item_id, count(x.doc_id) AS documents FROM (SELECT item_id, {quoted(d, 'text')} AS q FROM benchmark) b LEFT JOIN (SELECT doc_id, {key(d, 'text')} AS s FROM documents) x ON b.q <> '' AND contains(x.s, b.q) GROUP BY b.item_id"
}
