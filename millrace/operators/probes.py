"""Probes that ask whether a model can tell what it should not: cross-validated logistic regression on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, NGram, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space on both sides."""
    padded = F.transform(X.words(text), lambda w: F.concat(F.lit(" "), F.lower(w), F.lit(" ")))
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    of = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.flatten(F.transform(padded, lambda w: F.transform(sizes, lambda n: of(w, n)))))


def gate_auc(rows: DataFrame, text: str, label: str, group: str, folds: int = 3, features: int = 1 << 14, chars: bool = True) -> float:
    """Mean area under the curve of telling the labels apart from words, word pairs and character n-grams.

    Groups are dealt to folds by hash, so no group is on both sides of a fold. Term counts enter as given, so figures
    differ from sublinear weights.
    """
    base = rows.select(F.col(label).cast("double").alias("y"), X.words(F.lower(text)).alias("w"), F.pmod(F.xxhash64(group), F.lit(folds)).alias("fold"), *([char_grams(F.col(text)).alias("c")] if chars else []))
    stages = [NGram(n=2, inputCol="w", outputCol="w2"), HashingTF(numFeatures=features, inputCol="w", outputCol="t1"), HashingTF(numFeatures=features, inputCol="w2", outputCol="t2")]
    inputs = ["t1", "t2"]
    if chars:
        stages.append(HashingTF(numFeatures=features, inputCol="c", outputCol="t3"))
        inputs.append("t3")
    stages += [VectorAssembler(inputCols=inputs, outputCol="t"), IDF(inputCol="t", outputCol="features"), LogisticRegression(labelCol="y", regParam=0.01, maxIter=30)]
    score = BinaryClassificationEvaluator(labelCol="y")
    base = base.cache()
    aucs = [score.evaluate(Pipeline(stages=stages).fit(base.where(F.col("fold") != k)).transform(base.where(F.col("fold") == k))) for k in range(folds)]
    base.unpersist()
    return sum(aucs) / len(aucs)


def shortcut_probe(rows: DataFrame, columns: list[str], label: str, group: str, folds: int = 3, seed: int = 0) -> tuple[float, float]:
    """(AUC, AUC under shuffled labels) of a regression on a few structural numbers; near values mean no shortcut."""
    base = rows.select(*[F.col(c).cast("double") for c in columns], F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(group), F.lit(folds)).alias("fold"), F.xxhash64(F.lit(seed), group, *columns).alias("k"))
    share = base.agg(F.avg("y")).first()[0] or 0.0
    base = base.withColumn("null_y", (F.pmod("k", F.lit(10_000)) < share * 10_000).cast("double")).cache()
    model = lambda y: Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(labelCol=y, maxIter=30)])

    def auc(y: str) -> float:
        score = BinaryClassificationEvaluator(labelCol=y)
        parts = [score.evaluate(model(y).fit(base.where(F.col("fold") != k)).transform(base.where(F.col("fold") == k))) for k in range(folds)]
        return sum(parts) / len(parts)

    out = auc("y"), auc("null_y")
    base.unpersist()
    return out


def opening_probe(rows: DataFrame, text: str, label: str, group: str, words: int = 50, folds: int = 3, features: int = 1 << 14, seed: int = 0) -> tuple[float, float]:
    """(AUC, AUC under shuffled labels) of telling the label from a text's first words and word pairs; near values mean no shortcut.

    A term counts once a text, with its inverse document frequency, and classes weigh alike. Groups are dealt to folds
    by hash. The opening is the feature that is probed; nothing else of the text is looked at.
    """
    opening = F.slice(X.words(F.lower(text)), 1, words)
    base = rows.select(F.col(label).cast("double").alias("y"), opening.alias("w"), F.pmod(F.xxhash64(group), F.lit(folds)).alias("fold"), F.xxhash64(F.lit(seed), group, text).alias("k"))
    share = base.agg(F.avg("y")).first()[0] or 0.0
    pairs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    base = base.withColumn("terms", F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))))
    base = base.withColumn("null_y", (F.pmod("k", F.lit(10_000)) < share * 10_000).cast("double"))
    weighted = lambda y: F.when(F.col(y) == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    base = base.withColumn("y weight", weighted("y")).withColumn("null_y weight", weighted("null_y")).cache()

    def auc(y: str) -> float:
        stages = [HashingTF(numFeatures=features, inputCol="terms", outputCol="t"), IDF(inputCol="t", outputCol="features"), LogisticRegression(labelCol=y, weightCol=f"{y} weight", regParam=0.01, maxIter=30)]
        score = BinaryClassificationEvaluator(labelCol=y)
        parts = [score.evaluate(Pipeline(stages=stages).fit(base.where(F.col("fold") != k)).transform(base.where(F.col("fold") == k))) for k in range(folds)]
        return sum(parts) / len(parts)

    out = auc("y"), auc("null_y")
    base.unpersist()
    return out
