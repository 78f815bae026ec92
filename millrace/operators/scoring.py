"""Scores of model answers: pair scores, macro-F1, slices, floors and confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X

INVALID = "invalid"


def answer_status(answer: Column, options: Column) -> tuple[Column, Column]:
    """(status, answer as an option): exact, recovered after normalising (the last such option), or invalid."""
    alike = F.filter(options, lambda o: X.normal_answer(o) == X.normal_answer(answer))
    exact, found = F.array_contains(options, answer), F.size(alike) > 0
    status = F.when(F.coalesce(exact, F.lit(False)), "exact").when(F.coalesce(found & answer.isNotNull(), F.lit(False)), "recovered").otherwise(INVALID)
    return status, F.when(status == "exact", answer).when(status == "recovered", F.element_at(alike, -1)).otherwise(F.lit(INVALID))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Scored rows of (answer, options, gold, evidence, gold_evidence, n_lines): status, pred, credit and evidence scores.

    Evidence is valid if it is ascending, unique and within 1 .. n_lines; invalid or missing evidence scores zero. A
    recovered answer earns credit but is no right prediction.
    """
    status, found = answer_status(F.col("answer"), F.col("options"))
    ev, gold = F.col("evidence"), F.array_distinct("gold_evidence")
    valid = F.coalesce((ev == F.array_sort(F.array_distinct(ev))) & F.forall(ev, lambda e: (e >= 1) & (e <= F.col("n_lines"))), F.lit(False))
    shared, mine, theirs = F.size(F.array_intersect(ev, gold)), F.size(ev), F.size(gold)
    empty = lambda other: F.when(other == 0, 1.0).otherwise(0.0)
    precision = F.when(~valid, 0.0).when(mine > 0, shared / mine).otherwise(empty(theirs))
    recall = F.when(~valid, 0.0).when(theirs > 0, shared / theirs).otherwise(empty(mine))
    out = pairs.withColumn("status", status).withColumn("pred", F.when(status == "exact", found).otherwise(F.lit(INVALID))).withColumn("pred_raw", found)
    out = out.withColumn("credit", F.when(F.col("status") == "exact", 1.0).when(F.col("status") == "recovered", 0.3).otherwise(0.0))
    out = out.withColumn("ev_valid", valid).withColumn("ev_precision", precision).withColumn("ev_recall", recall)
    both = F.col("ev_precision") + F.col("ev_recall")
    return out.withColumn("ev_f1", F.when(both > 0, 2 * F.col("ev_precision") * F.col("ev_recall") / both).otherwise(0.0)).withColumn(
        "ev_exact", (valid & (F.size(F.array_except(ev, gold)) == 0) & (F.size(F.array_except(gold, ev)) == 0)).cast("double")
    ).withColumn("gold_empty", theirs == 0)


def macro_f1(rows: DataFrame, keys: list[str], pred: str = "pred", gold: str = "gold", options: str | None = "options") -> DataFrame:
    """(keys, macro_f1): mean F1 over gold classes and supplied options; classes neither gold nor predicted are left out.

    A prediction outside gold and options is no class of its own but costs its gold class. No class gives 0.
    """
    counted = rows.groupBy(*keys, gold, pred).agg(F.count("*").alias("n"))
    as_gold = counted.select(*keys, F.col(gold).alias("class"), F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.lit(1).alias("named"))
    as_pred = counted.select(*keys, F.col(pred).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).alias("named"))
    parts = as_gold.unionByName(as_pred)
    if options:
        given = rows.select(*keys, F.explode(options).alias("class")).distinct()
        parts = parts.unionByName(given.select(*keys, "class", *[F.lit(0).cast("long").alias(c) for c in ("tp", "g", "p")], F.lit(1).alias("named")))
    per = parts.groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.max("named").alias("named")).where("named = 1")
    return per.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("g") + F.col("p") > 0, 2 * F.col("tp") / (F.col("g") + F.col("p")))), F.lit(0.0)).alias("macro_f1"))


def majority(rows: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """(keys, majority): the most frequent answer, ties to the first by name."""
    counted = rows.groupBy(*keys, answer).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(answer).alias("a"))).alias("best"))
    return best.select(*keys, F.col("best.a").alias("majority"))


def slice_scores(scored: DataFrame, slices: Column) -> DataFrame:
    """(slice, metrics) for overlapping slices: ``slices`` gives each row the array of names it counts for."""
    rows = scored.withColumn("slice", F.explode(slices))
    right = (F.col("status") == "exact") & (F.col("pred") == F.col("gold"))
    share = lambda c: F.avg(c.cast("double"))
    metrics = rows.groupBy("slice").agg(
        F.count("*").alias("n"), share(F.col("status") == "exact").alias("answer_exact"), share(F.col("status") == "recovered").alias("answer_recovered"),
        share(F.col("status") == INVALID).alias("answer_invalid"), F.avg("credit").alias("answer_credit"), share(right).alias("accuracy"),
        share(F.col("ev_valid")).alias("ev_valid"), F.avg("ev_precision").alias("ev_precision"), F.avg("ev_recall").alias("ev_recall"), F.avg("ev_f1").alias("ev_f1"), F.avg("ev_exact").alias("ev_exact"),
        share(F.col("gold_empty")).alias("gold_empty_share"), F.avg(F.when(F.col("gold_empty"), F.col("ev_exact"))).alias("gold_empty_matched"),
        F.avg(F.when(~F.col("gold_empty"), F.col("ev_precision"))).alias("ev_precision_nonempty"), F.avg(F.when(~F.col("gold_empty"), F.col("ev_recall"))).alias("ev_recall_nonempty"),
    )
    return metrics.join(macro_f1(rows, ["slice"]), "slice")


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "gold", "pred").agg(F.count("*").alias("n"))


def fill_outputs(gold: DataFrame, outputs: DataFrame, key: str = "id", variants: str = "variants", order: str = "line") -> DataFrame:
    """One row for each record and variant it has: its first output's text, empty where there is none.

    Outputs of variants that a record lacks are ignored.
    """
    grid = gold.withColumn("variant", F.explode(variants))
    first = outputs.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "variant").orderBy(order))).where("_rank = 1").select(key, "variant", F.col("text").alias("_text"))
    return grid.join(first, [key, "variant"], "left").withColumn("text", F.coalesce("_text", F.lit(""))).drop("_text")


def shared_items(outputs: DataFrame, key: str, variant: str, n: int) -> DataFrame:
    """(key): items that have all ``n`` variants."""
    return outputs.select(key, variant).distinct().groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == n).select(key)
