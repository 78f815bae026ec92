"""Local search for a set of groups whose features come near to the whole's shares and reach their floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import written
from millrace.operators.ranks import seeded_hash
from millrace.operators.scans import within

#: Features of one kind of group whose terms bend at the count at hand: at most so many are matched between two kinds.
_BENDS = 8
#: Counts are whole and shares are quotients, so changes of the score below this are rounding.
_STEP = 1e-9


def _term(c: Column, n: int) -> Column:
    """What a feature with ``c`` of the chosen adds to the score: its share's deviation, or what its floor lacks."""
    return F.when(F.col("floor").isNotNull(), F.greatest(F.lit(0.0), F.col("floor") - c)).otherwise(F.abs(c / n - F.col("share")))


def score(kinds: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """One row (score): of chosen kinds (features, chosen) under ``targets`` (feature, share, floor)."""
    held = kinds.select(F.explode("features").alias("feature"), "chosen").groupBy("feature").agg(F.sum("chosen").alias("c"))
    return targets.join(held, "feature", "left").agg(F.coalesce(F.sum(_term(F.coalesce("c", F.lit(0)), n)), F.lit(0.0)).alias("score"))


def aims(groups: DataFrame, shares: str, floors: str, least: int) -> DataFrame:
    """(feature, share, floor): the whole's share of each feature in ``shares``, and for each in ``floors`` the lesser of ``least`` and half its groups."""
    total = groups.count()
    of = lambda c, name: groups.select(F.explode(F.array_distinct(c)).alias("feature")).where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("c")).select(F.concat(F.lit(name), "feature").alias("feature"), "c")
    a = of(shares, "share ").select("feature", (F.col("c") / max(total, 1)).alias("share"), F.lit(None).cast("double").alias("floor"))
    return a.unionByName(of(floors, "floor ").select("feature", F.lit(None).cast("double").alias("share"), F.least(F.lit(least), F.floor(F.col("c") / 2)).cast("double").alias("floor")))


def best_swaps(kinds: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(off, on, change): swaps of one group of kind ``off`` for one of kind ``on`` that lower the score, no two of which touch a feature.

    The least change of all swaps is among them. Without features in common a swap changes the score by what ``off`` loses
    and ``on`` adds; a common feature gives back its bend, which is not zero only where its term's slope turns at the
    count at hand. So the best swap is, for some set of bends, the best ``off`` and the best ``on`` that both have that set: two
    minima of a grouped aggregation, and kinds are never paired with each other.
    """
    held = kinds.select(F.explode("features").alias("feature"), "chosen").groupBy("feature").agg(F.sum("chosen").alias("c"))
    known = targets.join(held, "feature", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    slopes = known.select("feature", (_term(F.col("c") - 1, n) - _term(F.col("c"), n)).alias("lose"), (_term(F.col("c") + 1, n) - _term(F.col("c"), n)).alias("add"))
    slopes = slopes.withColumn("bend", F.when(F.col("lose") + F.col("add") > _STEP, F.col("lose") + F.col("add")).otherwise(0.0))
    each = kinds.select("kind", "chosen", "others", F.explode_outer("features").alias("feature")).join(slopes, "feature", "left")
    bends = F.slice(F.array_sort(F.collect_list(F.when(F.col("bend") > 0, F.struct((-F.col("bend")).alias("b"), "feature")))), 1, _BENDS)
    sums = each.groupBy("kind", "chosen", "others").agg(F.coalesce(F.sum("lose"), F.lit(0.0)).alias("lose"), F.coalesce(F.sum("add"), F.lit(0.0)).alias("add"), bends.alias("bends"))
    sets = F.aggregate("bends", F.array(F.struct(F.lit(0.0).alias("back"), F.array().cast("array<string>").alias("set"))), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.struct((s["back"] - x["b"]).alias("back"), F.array_append(s["set"], x["feature"]).alias("set")))))
    met = sums.withColumn("s", F.explode(sets)).select("kind", "chosen", "others", "lose", "add", "s.back", F.array_join(F.array_sort("s.set"), "\n").alias("set"))
    off = F.min(F.when(F.col("chosen") > 0, F.struct(F.col("lose").alias("d"), F.col("kind").alias("kind"))))
    on = F.min(F.when(F.col("others") > 0, F.struct(F.col("add").alias("d"), F.col("kind").alias("kind"))))
    pairs = met.groupBy("set").agg(off.alias("off"), on.alias("on"), F.max("back").alias("back"))
    ahead = pairs.select(F.col("off.kind").alias("off"), F.col("on.kind").alias("on"), (F.col("off.d") + F.col("on.d") - F.col("back")).alias("change")).where(F.col("change") < -_STEP)
    ahead = ahead.where("off <> on").groupBy("off", "on").agg(F.min("change").alias("change"))
    feats = kinds.select(F.col("kind").alias("k"), F.explode(F.array_append("features", F.concat(F.lit("kind "), "kind"))).alias("feature"))
    touched = ahead.join(feats, F.col("k") == F.col("off")).unionByName(ahead.join(feats, F.col("k") == F.col("on"))).drop("k").distinct()
    first = touched.groupBy("feature").agg(F.min(F.struct("change", "off", "on")).alias("first"))
    beaten = touched.join(first, "feature").where(F.struct("change", "off", "on") != F.col("first")).select("off", "on").distinct()
    return ahead.join(beaten, ["off", "on"], "left_anti")


def local_search(groups: DataFrame, group: str, shares: str, floors: str, n: int, least: int, seed: int, rounds: int = 200) -> DataFrame:
    """(group): ``n`` groups from which no swap of two groups comes nearer to the aims; never further than the seeded draw it starts from.

    ``shares`` and ``floors`` are array columns of names: a group's cells, whose shares should be the whole's (an absolute
    deviation each), and its rare answers, of which ``least`` (or half of what there is) should be held (one point for each that lacks).
    Groups with equal features are one kind; only kinds are searched. In each round the best swaps that touch no common
    feature are made at once, so the score falls by the sum of their changes; a round without one is a local optimum. (Kinds
    with more than eight bends at once are matched by the eight greatest.) Then each kind's groups are taken by seeded hash.

    Fewer groups than ``n`` are an error, as is a search that has not ended after ``rounds``. Null arrays have no features;
    repeated groups must be made one before.
    """
    names = F.array_sort(F.concat(
        F.transform(F.array_distinct(F.coalesce(F.col(shares), F.array().cast("array<string>"))), lambda x: F.concat(F.lit("share "), x)),
        F.transform(F.array_distinct(F.coalesce(F.col(floors), F.array().cast("array<string>"))), lambda x: F.concat(F.lit("floor "), x))))
    work = groups.select(F.col(group).alias("g"), F.filter(names, lambda x: x.isNotNull()).alias("features"))
    work = work.withColumn("mark", seeded_hash(seed, "g")).withColumn("kind", F.sha1(F.to_json("features").cast("binary"))).withColumn("part", F.substring("mark", 1, 3)).withColumn("one", F.lit(0)).withColumn("n", F.lit(n))
    work = written(work, "groups")[0]
    if work.count() < n:
        raise ValueError(f"cannot choose {n} groups of {work.count()}")
    targets = written(aims(groups, shares, floors, least), "aims")[0]
    placed = within(work, "one", "part", ["mark", "g"], "n", "place")
    taken = F.coalesce(F.col("place") <= n, F.lit(False)).cast("long")
    kinds = written(placed.groupBy("kind", "features").agg(F.sum(taken).alias("chosen"), F.sum(1 - taken).alias("others")), "kinds")[0]
    for _ in range(rounds):
        swaps = written(best_swaps(kinds, targets, n), "swaps")[0]
        if swaps.isEmpty():
            break
        moved = swaps.select(F.col("off").alias("kind"), F.lit(-1).alias("m")).unionByName(swaps.select(F.col("on").alias("kind"), F.lit(1).alias("m"))).groupBy("kind").agg(F.sum("m").alias("m"))
        m = F.coalesce("m", F.lit(0))
        kinds = written(kinds.join(moved, "kind", "left").select("kind", "features", (F.col("chosen") + m).alias("chosen"), (F.col("others") - m).alias("others")), "kinds")[0]
    else:
        raise ValueError(f"the search had not ended after {rounds} rounds")
    last = within(work.drop("n").join(kinds.select("kind", "chosen"), "kind"), "kind", "part", ["mark", "g"], "chosen", "place")
    return last.where(F.col("place") <= F.col("chosen")).select(F.col("g").alias(group))
