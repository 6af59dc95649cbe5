"""Trained text priorities: hashed terms and logistic regression, the best of several numbers of epochs by validation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = 1 << 12
EPOCHS = (1, 4, 12)


def train(rows: DataFrame, epochs: tuple[int, ...] = EPOCHS) -> tuple[object, list[tuple[int, float]]]:
    """O2: model over (text, label 0 or 1, validation) and the validation accuracy by number of epochs.

    Null texts are empty, null labels are left out; on ties fewer epochs win. Without validation rows the
    accuracy is 0 and the fewest epochs win; without training rows it is an error.
    """
    rows = rows.where("label is not null").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("label", F.col("label").cast("double"))
    words = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"), HashingTF(inputCol="words", outputCol="features", numFeatures=TERMS)])
    hashed = words.fit(rows).transform(rows).select("features", "label", "validation")
    fit, held = hashed.where("not validation"), hashed.where("validation")
    best, scores = None, []
    for n in epochs:
        model = LogisticRegression(maxIter=n, regParam=0.01, standardization=False).fit(fit)
        hits = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("a")).first().a or 0.0
        best = model if best is None or hits > max(s for _, s in scores) else best
        scores.append((n, float(hits)))
    return best, scores


def o2_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 over conversations: which role wrote a turn; conversations are held out whole, a quarter by hash."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select("text", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"), (F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 0).alias("validation"))
    _, scores = train(rows)
    return spark.createDataFrame([(n, round(s, 4), (n, s) == max(scores, key=lambda x: (x[1], -x[0]))) for n, s in scores], "epochs long, accuracy double, chosen boolean")


PLANS = {"o2_training": o2_training}
