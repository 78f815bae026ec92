"""Agreement of two labellers: kappa, cut and stop rules, skew and disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules.
LEAST_PAIRS, KAPPA_CUT, NONE_CUT, TOP_CUT, STOP_GAP = 20, 0.40, 0.75, 0.90, 0.20


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, pairs, agreement, kappa): Cohen's kappa; if chance explains all, 1 at full agreement, else null.

    Only counts of answers meet in a join, so a group's size does not matter.
    """
    joint = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    whole = joint.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = joint.groupBy(*keys, F.col(a).alias("x")).agg(F.sum("n").alias("na"))
    right = joint.groupBy(*keys, F.col(b).alias("x")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*keys, "x"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    out = whole.join(chance, keys, "left")
    agree, expected = F.col("same") / F.col("pairs"), F.coalesce(F.col("both"), F.lit(0)) / (F.col("pairs") * F.col("pairs"))
    value = F.when(expected >= 1.0, F.when(agree == 1.0, 1.0)).otherwise((agree - expected) / (1.0 - F.when(expected >= 1.0, 0.0).otherwise(expected)))
    return out.select(*keys, "pairs", agree.alias("agreement"), value.alias("kappa"))


def cut_rules(by_stratum: DataFrame, answers: DataFrame, question: str, strata: list[str], none: str = "none") -> DataFrame:
    """(question, measurable, reasons): why a question is cut.

    ``by_stratum`` is kappa by question and stratum; ``answers`` has one row for each of the first labeller's answers.
    """
    k = by_stratum.groupBy(question).pivot("stratum", strata).agg(F.first("pairs").alias("pairs"), F.first("kappa").alias("kappa"))
    measurable = F.lit(True)
    low = []
    for s in strata:
        measurable = measurable & (F.coalesce(F.col(f"`{s}_pairs`"), F.lit(0)) >= LEAST_PAIRS)
        low.append(F.when(F.bround(F.col(f"`{s}_kappa`"), 3) < KAPPA_CUT, F.concat(F.lit("kappa "), F.bround(F.col(f"`{s}_kappa`"), 3).cast("string"), F.lit(f" in {s}"))))
    counted = answers.groupBy(question, "answer").agg(F.count("*").alias("n"))
    skew = counted.groupBy(question).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.when(F.col("answer") == none, F.col("n")).otherwise(0)).alias("none"))
    out = k.withColumn("measurable", measurable).withColumn("low", F.when(measurable, F.array_compact(F.array(*low))).otherwise(F.array().cast("array<string>")))
    out = out.join(skew, question)
    flags = F.array_compact(F.array(F.when(F.col("none") / F.col("n") > NONE_CUT, F.lit("mostly none")), F.when(F.col("top") / F.col("n") > TOP_CUT, F.lit("one answer"))))
    return out.select(question, "measurable", F.concat("low", flags).alias("reasons"))


def stop_rule(by_stratum: DataFrame, cut: DataFrame, question: str, short: str, long: str) -> DataFrame:
    """(stratum, mean_kappa, stops): bank means of measurable questions; the long one stops a study that degrades."""
    fit = by_stratum.join(cut.where("measurable").select(question), question, "left_semi")
    means = fit.groupBy("stratum").agg(F.bround(F.avg(F.bround("kappa", 3)), 3).alias("mean_kappa"))
    base = means.where(F.col("stratum") == short).select(F.col("mean_kappa").alias("base"))
    out = means.join(F.broadcast(base), F.lit(True), "left")  # one row
    stops = (F.col("stratum") == long) & ((F.col("mean_kappa") < KAPPA_CUT) | (F.col("base") - F.col("mean_kappa") > STOP_GAP))
    return out.select("stratum", "mean_kappa", F.coalesce(stops, F.lit(False)).alias("stops"))


def labeller_report(rows: DataFrame, labeller: str, answer: str, gold: str, tags: str, gold_tags: str) -> DataFrame:
    """(labeller, n, accuracy, rare_recall, tag_jaccard): tags empty on both sides are skipped."""
    both = F.size(F.array_union(tags, gold_tags))
    jac = F.when(both > 0, F.size(F.array_intersect(tags, gold_tags)) / both)
    hit = (F.col(answer) == F.col(gold)).cast("double")
    return rows.groupBy(labeller).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.when(F.col(gold) != "none", hit)).alias("rare_recall"), F.avg(jac).alias("tag_jaccard"))


def grade_agreement(rows: DataFrame, keys: list[str], judge: str, person: str) -> DataFrame:
    """(keys, n, exact, within_one): of two grades on one scale."""
    gap = F.abs(F.col(judge) - F.col(person))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one"))


def answer_shares(rows: DataFrame, keys: list[str], answer: str, skew: float = 0.8) -> DataFrame:
    """(keys, answer, n, share, skewed): an answer's share, and whether the key's top share reaches ``skew``."""
    counted = rows.groupBy(*keys, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    out = counted.withColumn("share", F.col("n") / F.sum("n").over(w))
    return out.withColumn("skewed", F.max("share").over(w) >= skew)


def strict_majority(votes: DataFrame, key: str, labeller: str, answer: str) -> DataFrame:
    """(key, voters, answer, disputed): the answer of over half the labellers; null and disputed where there is none."""
    counted = votes.groupBy(key, answer).agg(F.countDistinct(labeller).alias("n"))
    top = counted.groupBy(key).agg(F.sum("n").alias("voters"), F.min(F.struct((-F.col("n")).alias("n"), F.col(answer).alias("a"))).alias("t"))
    wins = -F.col("t.n") * 2 > F.col("voters")
    return top.select(key, "voters", F.when(wins, F.col("t.a")).alias(answer), (~wins).alias("disputed"))


def evidence_thirds(cites: DataFrame, keys: list[str], third: Column) -> DataFrame:
    """(keys, cited, first, middle, last): shares of cited lines by third, to four places."""
    rows = cites.withColumn("_third", third)
    share = lambda t: F.bround(F.avg((F.col("_third") == t).cast("double")), 4).alias(t)
    return rows.groupBy(*keys).agg(F.count("*").alias("cited"), share("first"), share("middle"), share("last"))
