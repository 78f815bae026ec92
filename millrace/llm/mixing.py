"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import new_name, remove, scratch_path, stored

#: Targets are shares of tokens to this power, so small groups gain and none is lost.
POWER = 0.85
ROUNDS, TOLERANCE = 40, 1e-9
#: Cells that are raked inside one row, by functions of arrays; more are raked as tables, round by round.
ROW_CELLS = 512
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A coarse topic from a text's form, for tables without a topic: list, note, article, long or empty."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    return F.when(tokens == 0, "empty").when(lines * 12 >= tokens, "list").when(tokens < 120, "note").when(tokens < 600, "article").otherwise("long")


def tempered_targets(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """(margin, target): each value's share of tokens to the power, made to sum to one."""
    sums = cells.groupBy(margin).agg(F.sum("w").alias("w"))
    raised = sums.select(margin, F.pow(F.col("w").cast("double"), F.lit(power)).alias("v"))
    whole = raised.agg(F.sum("v").alias("whole"))
    return raised.join(F.broadcast(whole)).select(margin, (F.col("v") / F.col("whole")).alias("target"))  # one row


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value found once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _raked_row(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """``rake`` over few cells: an array of weights is folded over all rounds and margins; each margin's values are numbered."""
    numbered = cells
    for margin, target in targets.items():
        place = target.withColumn(f"{margin} number", F.row_number().over(Window.orderBy(margin)) - 1)
        numbered = numbered.join(place.withColumnRenamed("target", f"{margin} target"), margin)
    places = F.array(*[F.struct(F.col(f"{m} number").alias("k"), F.col(f"{m} target").alias("target")) for m in targets])
    row = numbered.agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in cells.columns], places.alias("places")))).alias("cells"))
    start = F.struct(F.transform("cells", lambda x: x["w"].cast("double")).alias("fitted"), F.lit(0.0).alias("gap"), F.lit(False).alias("done"))

    def step(state: Column, i: Column) -> Column:
        margin = i % len(targets)
        at = lambda x: F.get(x["places"], margin)
        values = F.sequence(F.lit(0), F.array_max(F.transform("cells", lambda x: at(x)["k"])))
        pairs = F.zip_with("cells", state["fitted"], lambda x, f: F.struct(at(x)["k"].alias("k"), f.alias("f")))
        sums = _bound(pairs, lambda p: F.transform(values, lambda k: F.aggregate(F.filter(p, lambda y: y["k"] == k), F.lit(0.0), lambda s, y: s + y["f"])))
        factors = _bound(sums, lambda s: F.transform("cells", lambda x: at(x)["target"] / F.get(s, at(x)["k"])))
        last = margin == len(targets) - 1

        def after(f: Column) -> Column:
            gap = F.greatest(F.when(margin == 0, 0.0).otherwise(state["gap"]), F.array_max(F.transform(f, lambda x: F.abs(x - 1))))
            return F.struct(F.zip_with(state["fitted"], f, lambda a, b: a * b).alias("fitted"), gap.alias("gap"), (last & (gap < tolerance)).alias("done"))

        return F.when(state["done"], state).otherwise(_bound(factors, after))

    fitted = F.aggregate(F.sequence(F.lit(0), F.lit(rounds * len(targets) - 1)), start, step, lambda s: s["fitted"])
    out = row.select(F.explode(F.zip_with("cells", fitted, lambda x, f: F.struct(*[x[c].alias(c) for c in cells.columns], f.alias("fitted")))).alias("x"))
    return out.select("x.*")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, row_cells: int = ROW_CELLS) -> DataFrame:
    """Iterative proportional fitting: the columns of ``cells`` with ``fitted``, whose sums meet the targets.

    ``cells`` has the margins' columns and the weight ``w`` > 0; a target table has a margin and its share.
    Rounds end when every margin is met within the tolerance, or after ``rounds``. Targets that the cells
    cannot meet (a value without cells) leave the nearest raked weights. At most ``row_cells`` cells are one row, whose
    rounds are a fold in one expression; beyond that each round is a table in the shared folder and nothing is
    collected but its largest gap. Both ways do the same sums.
    """
    if cells.limit(row_cells + 1).count() <= row_cells:
        return _raked_row(cells, targets, rounds, tolerance)
    spark = cells.sparkSession
    tables = {m: stored(t, f"target-{m}") for m, t in targets.items()}
    path = scratch_path(spark, "raked")
    now = stored(cells.withColumn("fitted", F.col("w").cast("double")), "raked", path)
    columns = [*cells.columns, "fitted"]
    for _ in range(rounds):
        new = now.withColumn("gap", F.lit(0.0))
        for margin, target in tables.items():
            sums = new.groupBy(margin).agg(F.sum("fitted").alias("sum"))
            factor = sums.join(target, margin).select(margin, (F.col("target") / F.col("sum")).alias("factor"))
            new = new.join(factor, margin)
            new = new.select(*cells.columns, (F.col("fitted") * F.col("factor")).alias("fitted"), F.greatest("gap", F.abs(F.col("factor") - 1)).alias("gap"))
        to = scratch_path(spark, "raked")
        after = stored(new, "raked", to)
        gap = after.agg(F.max("gap")).first()[0]
        now = after.select(*columns)
        remove(spark, path)
        path = to
        if gap is None or gap < tolerance:
            break
    return now


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, source: Column, language: Column, topic: Column, tokens: Column, id_col: str = "doc_id", text_col: str = "text", power: float = POWER, seed: str = "mix", taken: str = "mix") -> DataFrame:
    """The sampled rows of ``docs`` with a struct column named ``taken``: source, language, topic, n_tokens, probability.

    Token weights are raked to tempered targets of source, language and topic. A row's probability is
    its cell's raked weight over its plain weight, scaled so that the highest is one; then the expected tokens
    of the sample stand in the target proportions. The draw is a hash of the id (of the text where the id is
    null), so equal rows share their fate and reruns agree. Null values of a margin are a value of
    their own (""); rows without tokens have no weight to rake and go. An empty table stays empty.
    """
    names = [new_name(docs, n) for n in ("mix_source", "mix_language", "mix_topic", "mix_tokens")]
    s, lang, t, n = names
    rows = docs.withColumns({s: F.coalesce(source.cast("string"), F.lit("")), lang: F.coalesce(language.cast("string"), F.lit("")), n: tokens})
    rows = rows.withColumn(t, F.coalesce(topic, F.lit("")))
    cells = rows.groupBy(s, lang, t).agg(F.sum(n).alias("w")).where("w > 0")
    cells = stored(cells.select(F.col(s).alias("source"), F.col(lang).alias("language"), F.col(t).alias("topic"), "w"), "cells")
    fitted = rake(cells, {m: tempered_targets(cells, m, power) for m in ("source", "language", "topic")})
    ratio = fitted.select("source", "language", "topic", (F.col("fitted") / F.col("w")).alias("ratio"))
    most = ratio.agg(F.max("ratio").alias("most"))
    chance = stored(ratio.join(F.broadcast(most)).select(F.col("source").alias("s_"), F.col("language").alias("l_"), F.col("topic").alias("t_"), (F.col("ratio") / F.col("most")).alias("p_")), "chances")
    same = (F.col(s) == F.col("s_")) & (F.col(lang) == F.col("l_")) & (F.col(t) == F.col("t_"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.lit(""))
    # One condition on both sides: a filter of its own on the tokens would be put below the join and count them again.
    kept = rows.join(chance, same).where(uniform(key, seed) < F.when(F.col(n) > 0, F.col("p_")))
    about = F.struct(F.col(s).alias("source"), F.col(lang).alias("language"), F.col(t).alias("topic"), F.col(n).alias("n_tokens"), F.col("p_").alias("probability"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], about.alias(taken))
