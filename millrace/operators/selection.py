"""Choosing whole groups for a split: candidates are scored in parallel, the best plan is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import fresh
from millrace.operators.ranks import seeded_hash


def best_draw(groups: DataFrame, group: str, stratum: str, n: int, draws: int, seed: int) -> DataFrame:
    """(group, stratum): ``n`` groups whose strata come nearest to the whole's shares, of ``draws`` seeded draws.

    Every draw is a hash order; all draws are ranked and scored at once, then one is kept (ties: the first). A draw's
    rank needs only groups among its ``n`` least hashes, so the join stays at draws x n rows after the cut.
    """
    whole = groups.groupBy(stratum).agg(F.count("*").alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy()))  # one row for each stratum
    tries = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    named = groups.select(group, stratum, tries)
    order = Window.partitionBy("draw").orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), "draw", group).cast("binary")), group)
    taken = named.withColumn(place := fresh("place", groups), F.row_number().over(order)).where(F.col(place) <= n).drop(place)
    cells = whole.select(stratum, "share", tries)
    counts = taken.groupBy("draw", stratum).agg(F.count("*").alias("k"))
    gap = cells.join(counts, ["draw", stratum], "left").groupBy("draw").agg(F.sum(F.abs(F.coalesce("k", F.lit(0)) / n - F.col("share"))).alias("gap"))
    best = gap.orderBy("gap", "draw").limit(1).select("draw")
    return taken.join(F.broadcast(best), "draw", "left_semi").select(group, stratum)


def quota_draw(rows: DataFrame, item: str, stratum: str, podcast: str, quotas: DataFrame, cap: int, seed: int) -> DataFrame:
    """Items by seeded hash until each stratum's quota, at most ``cap`` of a podcast over all strata.

    The cap is applied first, by hash order, so the result does not depend on the order of strata; where a podcast
    spans strata this can differ from a one-pass greedy scan, which no distributed plan can follow.
    """
    own, place, most = (fresh(x, rows) for x in ("own", "place", "quota"))
    capped = rows.withColumn(own, F.row_number().over(Window.partitionBy(podcast).orderBy(seeded_hash(seed, item), item))).where(F.col(own) <= cap)
    placed = capped.withColumn(place, F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_hash(seed, item), item)))
    return placed.join(quotas.select(stratum, F.col("quota").alias(most)), stratum).where(F.col(place) <= F.col(most)).drop(own, place, most)


def straddles(assigned: DataFrame, group: str, side: str) -> DataFrame:
    """(group, sides): groups with documents on more than one side; a split without leaks has none."""
    return assigned.groupBy(group).agg(F.count_distinct(side).alias("sides")).where("sides > 1")


def floored_draw(groups: DataFrame, group: str, stratum: str, positives: str, long: str, n: int, draws: int, seed: int, least_positives: int, least_long: int) -> DataFrame:
    """(group, stratum): as ``best_draw``, of the draws that hold enough positive records and enough groups of the long tail.

    ``positives`` counts a group's positive records, ``long`` says whether it is of the long tail. A draw short of either floor
    loses to any that is not, and among those by what is missing; then strata's deviation decides, then the draw's number.
    """
    whole = groups.groupBy(stratum).agg(F.count("*").alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy()))  # one row for each stratum
    tries = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    named = groups.select(group, stratum, positives, long, tries)
    order = Window.partitionBy("draw").orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), "draw", group).cast("binary")), group)
    taken = named.withColumn(place := fresh("place", groups), F.row_number().over(order)).where(F.col(place) <= n).drop(place)
    missing = F.greatest(F.lit(0), least_positives - F.sum(F.coalesce(F.col(positives), F.lit(0)))) + F.greatest(F.lit(0), least_long - F.count_if(F.coalesce(F.col(long), F.lit(False))))
    short = taken.groupBy("draw").agg(missing.alias("missing"))
    counts = taken.groupBy("draw", stratum).agg(F.count("*").alias("k"))
    gap = whole.select(stratum, "share", tries).join(counts, ["draw", stratum], "left").groupBy("draw").agg(F.round(F.sum(F.abs(F.coalesce("k", F.lit(0)) / n - F.col("share"))), 9).alias("gap"))
    best = gap.join(short, "draw").orderBy("missing", "gap", "draw").limit(1).select("draw")
    return taken.join(F.broadcast(best), "draw", "left_semi").select(group, stratum)
