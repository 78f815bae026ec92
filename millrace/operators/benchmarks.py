"""A benchmark's score card: format scores, summaries of overlapping slices, floors that read no transcript, bank audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.names import fresh
from millrace.operators import agreement, scoring

#: Questions that a card slices one by one at most; a rare event's rows with it and its agreement at least.
MOST_QUESTIONS, LEAST_POSITIVES, RARE_CUT = 32, 3, 0.80


def format_scores(scored: DataFrame, vocabulary: str, tags: str, gold_tags: str, summary: str) -> DataFrame:
    """Scored pairs with ``tag_jaccard`` and ``format_valid``.

    Questions without tags have no tag score. Missing tags score zero; tags empty on both sides score one; a tag outside
    the vocabulary is a wrong one. The format is valid with an exact option, valid evidence and a summary.
    """
    mine, theirs = F.array_distinct(tags), F.array_distinct(gold_tags)
    both = F.size(F.array_union(mine, theirs))
    tag = F.when(F.col(tags).isNull(), 0.0).when(both == 0, 1.0).otherwise(F.size(F.array_intersect(mine, theirs)) / both)
    out = scored.withColumn("tag_jaccard", F.when(F.coalesce(F.size(vocabulary), F.lit(0)) > 0, tag))
    return out.withColumn("format_valid", (F.col("status") == "exact") & F.col("ev_valid") & F.col(summary).isNotNull())


def _distribution(rows: DataFrame, value: str, name: str) -> DataFrame:
    counted = rows.groupBy("slice", value).agg(F.count("*").alias("n"))
    return counted.groupBy("slice").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(value, F.lit("")), "n")))).alias(name))


def summaries(scored: DataFrame, slices: Column, majority: str | None = None) -> DataFrame:
    """(slice, all metrics, pred_distribution, gold_distribution) of overlapping slices.

    ``scored`` has the columns of ``score_pairs`` and ``format_scores`` and ``parsed``; with ``majority``, a column of
    blind answers, their macro-F1 comes too. Means skip nulls; no rows give no slice. A distribution has a
    count for each option, so it is as small as the options are few.
    """
    rows = scored.withColumn("slice", F.explode(slices))
    more = rows.groupBy("slice").agg(F.avg(F.col("parsed").cast("double")).alias("parsed"), F.avg(F.col("format_valid").cast("double")).alias("format_valid"), F.avg("tag_jaccard").alias("tag_jaccard"))
    out = scoring.slice_scores(scored, slices).join(more, "slice")
    if majority:
        out = out.join(scoring.macro_f1(rows, ["slice"], pred=majority).withColumnRenamed("macro_f1", "majority_macro_f1"), "slice")
    return out.join(_distribution(rows, "pred", "pred_distribution"), "slice").join(_distribution(rows, "gold", "gold_distribution"), "slice")


def card_slices(rows: DataFrame, twinned: tuple[str, ...] = (), priority: tuple[str, ...] = ()) -> Column:
    """The names of the slices that a row counts for.

    ``rows`` has dataset, family, cell, qid, difficult, over_cap, band, prompt_tokens, format_valid, gated and
    shortcut; nulls of the flags and the band give no slice. Questions get slices of their own if there are few; if
    there are many, those held out do, with and without gated rows. ``twinned`` are held-out questions that a trained
    one mirrors; ``priority`` families are also sliced by dataset.
    """
    few = rows.select("qid").distinct().limit(MOST_QUESTIONS + 1).count() <= MOST_QUESTIONS
    c, named = F.col, lambda name, v: F.concat(F.lit(f"{name}="), v.cast("string"))
    unseen, valid, gated = c("cell") == "unseen_q", F.coalesce(c("format_valid"), F.lit(False)), F.coalesce(c("gated"), F.lit(False))
    own_twin = c("qid").isin(*twinned) if twinned else F.lit(False)
    in_band = F.concat(named("band", c("band")), F.lit("/"), named("cell", c("cell")))
    question = named("qid", c("qid"))
    names = [
        F.lit("overall"), named("dataset", c("dataset")), named("family", c("family")), named("cell", c("cell")), F.when(F.lit(few) | unseen, question),
        F.when(F.lit(not few) & unseen & ~gated, F.concat(question, F.lit("/ungated"))), named("difficult", c("difficult")), named("over_cap", c("over_cap")),
        F.when(unseen & ~own_twin, "cell=unseen_q_no_twin"), F.when(unseen & ~own_twin & ~gated, "cell=unseen_q_ungated"), F.when(valid, F.concat(named("cell", c("cell")), F.lit("/valid_only"))),
        named("band", c("band")), in_band, F.when(valid, F.concat(in_band, F.lit("/valid_only"))), F.when(~F.coalesce(c("shortcut"), F.lit(False)), F.concat(in_band, F.lit("/no_shortcut"))),
        named("length", X.length_bucket("prompt_tokens")), F.when(c("family").isin(*priority), F.concat(F.lit("priority="), "family", F.lit("/"), "dataset")) if priority else F.lit(None).cast("string"),
    ]
    return F.array_compact(F.array(*names))


def floors(gold: DataFrame, keys: list[str], question: str = "question", answer: str = "gold", options: str = "options") -> DataFrame:
    """Rows of ``gold`` with ``majority``: the key's most frequent answer.

    A question of a single row takes the majority over all rows with the same options, for its own would be its gold.
    """
    once, own, wide = (fresh(n, gold) for n in ("once", "own", "wide"))
    alone = gold.groupBy(question).agg((F.count("*") == 1).alias(once))
    best = scoring.majority(gold, keys, answer).withColumnRenamed("majority", own)
    alike = scoring.majority(gold, [options], answer).withColumnRenamed("majority", wide)
    both = gold.join(alone, question).join(best, keys).join(alike, options)
    return both.select(*gold.columns, F.when(F.col(once), F.col(wide)).otherwise(F.col(own)).alias("majority"))


def blind(rows: DataFrame, answer: str) -> DataFrame:
    """The rows scored as if ``answer`` had been given without evidence, tags or a summary's text."""
    none = F.array().cast("array<bigint>")
    return scoring.score_pairs(rows.withColumn("answer", F.col(answer)).withColumn("evidence", none))


def rare_rule(pairs: DataFrame, question: str, a: str, b: str, stratum: str, strata: list[str], none: str = "none") -> DataFrame:
    """(question, positives, positive_agreement, measurable, reasons) for questions about rare events.

    Agreement replaces kappa, which a rare event makes meaningless; a question is measured with enough pairs in each
    stratum and enough rows where ``a`` says that the event happened.
    """
    same = F.avg((F.col(a) == F.col(b)).cast("double"))
    per = pairs.groupBy(question).pivot(stratum, strata).agg(F.count(F.lit(1)).alias("n"), F.bround(same, 3).alias("agreement"))
    yes = pairs.groupBy(question).agg(F.count_if(F.col(a) != none).alias("positives"), F.bround(F.avg(F.when(F.col(a) != none, (F.col(a) == F.col(b)).cast("double"))), 3).alias("positive_agreement"))
    enough = F.col("positives") >= LEAST_POSITIVES
    for s in strata:
        enough = enough & (F.coalesce(F.col(f"`{s}_n`"), F.lit(0)) >= agreement.LEAST_PAIRS)
    low = [F.when(F.col(f"`{s}_agreement`") < RARE_CUT, F.concat(F.lit("agreement in "), F.lit(s))) for s in strata]
    out = per.join(yes, question).withColumn("measurable", enough)
    return out.select(question, "positives", "positive_agreement", "measurable", F.when(F.col("measurable"), F.array_compact(F.array(*low))).otherwise(F.array().cast("array<string>")).alias("reasons"))


def labeller_costs(labels: DataFrame, labeller: str, cost: str, at: str, evidence: str) -> DataFrame:
    """(labeller, labels, cost_per_label, labels_per_minute, empty_evidence): null times count for no span; no span gives 0 a minute."""
    minutes = (F.max(F.col(at)).cast("double") - F.min(F.col(at)).cast("double")) / 60
    return labels.groupBy(labeller).agg(
        F.count("*").alias("labels"), F.avg(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost_per_label"), F.when(minutes > 0, F.count("*") / minutes).otherwise(0.0).alias("labels_per_minute"),
        F.avg((F.coalesce(F.size(evidence), F.lit(0)) <= 0).cast("double")).alias("empty_evidence"),
    )


def swapped_answers(rows: DataFrame, labeller: str, answer: str, gold: str, a: str, b: str) -> DataFrame:
    """(labeller, a_for_b, b_for_a): how often a labeller says ``a`` where ``b`` is right, and the reverse."""
    both = lambda x, y: F.count_if((F.col(answer) == x) & (F.col(gold) == y))
    return rows.groupBy(labeller).agg(both(a, b).alias("a_for_b"), both(b, a).alias("b_for_a"))


def bank_audit(votes: DataFrame, question: str, dataset: str, labeller: str, answer: str, none: str, none_cut: float = 0.75, top_cut: float = 0.90) -> DataFrame:
    """(question, dataset, labellers, none_dominant, skewed, disputed): what most labellers' answers say of a question on a dataset.

    A labeller flags a cell as mostly ``none`` or else as skewed to one answer by its own shares; over half the
    labellers decide, and a flag that some but not all raise is disputed.
    """
    counted = votes.groupBy(question, dataset, labeller, answer).agg(F.count("*").alias("c"))
    shares = counted.groupBy(question, dataset, labeller).agg((F.max("c") / F.sum("c")).alias("top"), (F.sum(F.when(F.col(answer) == none, F.col("c")).otherwise(0)) / F.sum("c")).alias("none"))
    flagged = shares.select(question, dataset, (F.col("none") >= none_cut).alias("x"), ((F.col("none") < none_cut) & (F.col("top") >= top_cut)).alias("y"))
    n = flagged.groupBy(question, dataset).agg(F.count("*").alias("labellers"), F.count_if("x").alias("x"), F.count_if("y").alias("y"))
    split = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("labellers"))
    return n.select(question, dataset, "labellers", (F.col("x") * 2 > F.col("labellers")).alias("none_dominant"), (F.col("y") * 2 > F.col("labellers")).alias("skewed"), (split("x") | split("y")).alias("disputed"))


def allow_list_changes(audit: DataFrame, current: DataFrame, question: str, dataset: str) -> DataFrame:
    """(question, add, drop): datasets that the audit would allow and the list lacks, and the reverse, of audited ones."""
    probed = audit.select(question, dataset, (~F.col("none_dominant")).alias("allow"))
    both = probed.join(current.select(question, dataset).distinct().withColumn("now", F.lit(True)), [question, dataset], "left").withColumn("now", F.coalesce("now", F.lit(False)))
    pick = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col(dataset))))
    return both.groupBy(question).agg(pick(F.col("allow") & ~F.col("now")).alias("add"), pick(~F.col("allow") & F.col("now")).alias("drop"))
