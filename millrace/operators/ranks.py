"""Ranking operators: nearest-rank distributions, first-wins, seeded choices, round-robin and allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.functions.names import fresh
from millrace.operators.components import written


def nearest_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, min, p50, p90, p99, max): elements of the sorted values at floor(p * n), at most the last.

    A value's rank is found from counts of distinct values, so no group is collected. Null values do not count; null keys
    are a group like any other; equal rows all count; an empty table gives no rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    def at(p: float) -> Column:
        place = F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(value)))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("min"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("max"))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given (total) order; null keys are a key like any other."""
    rank = fresh("rank", df)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def seeded_hash(seed: int | str, *parts: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def choose_per_key(df: DataFrame, key: str, item: str, k: int, seed: int) -> DataFrame:
    """The k items of each key with the least seeded hash. A larger k keeps all that a smaller one keeps.

    Null keys are a key like any other; equal items tie, and any of them is taken. An empty table stays empty.
    """
    place, rank = F.row_number().over(Window.partitionBy(key).orderBy(seeded_hash(seed, key, item), item)), fresh("rank", df)
    return df.withColumn(rank, place).where(F.col(rank) <= k).drop(rank)


def capped(df: DataFrame, group: str, item: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` items of each group, by seeded hash."""
    return choose_per_key(df, group, item, cap, seed)


def round_robin(df: DataFrame, group: str, item: str, limit: int, seed: int) -> DataFrame:
    """(columns, turn, place): one item of each group in turn until ``limit`` items are taken.

    Groups take turns by size (largest first, then name); within a group items come by seeded hash. Only the
    turns that can be reached are ordered over all groups.
    """
    size = fresh("size", df)
    sizes = df.groupBy(group).agg(F.count("*").alias(size))
    inside = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(seeded_hash(seed, item), item)))
    reach = inside.where(F.col("turn") <= limit).join(sizes, group)
    return reach.orderBy("turn", F.desc(size), group).limit(limit).withColumn("place", F.row_number().over(Window.orderBy("turn", F.desc(size), group))).drop(size)


#: Ranges that a stratum's order is cut into.
_RANGES = 256


def numbered(df: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """Rows of each key numbered from zero in the order of ``item``, without a key's rows passing one task.

    Approximate quantiles, stored once, cut a key's numeric items into ranges; only the ranges' counts pass a window of
    the key. Other types are numbered in one range. Null items come first; equal items stand in one range, in any order.
    """
    if not isinstance(df.schema[item].dataType, NumericType):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(item)) - 1)
    part, edges = fresh("part", df), fresh("edges", df)
    shares = F.array(*[F.lit(i / _RANGES) for i in range(1, _RANGES)])
    known = written(df.groupBy(*keys).agg(F.percentile_approx(item, shares, F.lit(16 * _RANGES)).alias(edges)), "ranges")[0]
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(known[k]) for k in keys])
    cut = df.join(known, same).select(*[df[c] for c in df.columns], F.coalesce(F.size(F.filter(edges, lambda e: e <= df[item])), F.lit(0)).alias(part))
    cut = cut.withColumn(part, F.when(F.col(item).isNull(), -1).otherwise(F.col(part)))
    own, before = fresh("own", df), fresh("before", df)
    sizes = cut.groupBy(*keys, part).agg(F.count("*").alias(own))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"{part} {k}") for k in keys], F.col(part).alias(f"{part} at"), F.coalesce(F.sum(own).over(w), F.lit(0)).alias(before))
    inside = cut.withColumn(own, F.row_number().over(Window.partitionBy(*keys, part).orderBy(item)) - 1)
    both = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"`{part} {k}`")) for k in keys]) & (F.col(part) == F.col(f"`{part} at`"))
    return inside.join(starts, both).select(*df.columns, (F.col(own) + F.col(before)).alias(name))


def chunks(df: DataFrame, stratum: str, item: str, size: int) -> DataFrame:
    """Rows with ``chunk``: consecutive items of a stratum, ``size`` to a chunk, the last one short.

    A hot stratum is numbered range by range. An empty table stays empty; null items come first.
    """
    return numbered(df, [stratum], item, n := fresh("n", df)).withColumn("chunk", F.floor(F.col(n) / size)).drop(n)


def allocate(cells: DataFrame, n: int, group: list[str], cell: str, count: str) -> DataFrame:
    """(columns, seats): ``n`` split over a group's cells in proportion to their counts, by largest remainder, ties to the first cell.

    A group's cells are few and meet in one window. An empty table stays empty.
    """
    raw, rank, left = (fresh(x, cells) for x in ("raw", "rank", "left"))
    w = Window.partitionBy(*group)
    whole = cells.withColumn(raw, F.lit(n) * F.col(count) / F.sum(count).over(w)).withColumn("seats", F.floor(raw))
    place = F.row_number().over(w.orderBy(F.desc(F.col(raw) - F.col("seats")), cell))
    ranked = whole.withColumn(rank, place).withColumn(left, F.lit(n) - F.sum("seats").over(w))
    return ranked.withColumn("seats", F.col("seats") + (F.col(rank) <= F.col(left)).cast("int")).drop(raw, rank, left)


def quantile_cuts(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, cuts): the sorted values at index n * i // bins for i in 1 .. bins - 1; nulls do not count.

    Exact, in two passes: approximate quantiles, whose error in rank is bounded, bracket each cut; then what lies
    below a bracket is counted, and only the few values inside are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    shares = [min(1.0, max(0.0, i / bins + d)) for i in range(1, bins) for d in (-_SLACK, _SLACK)]
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(_ACCURACY)).alias("edges"))
    first = written(first, "cuts")[0]  # once: a second run could bracket otherwise
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.get("edges", F.lit(2 * i - 2)).alias("low"), F.get("edges", F.lit(2 * i - 1)).alias("high")) for i in range(1, bins)])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(first[k]) for k in keys])
    met = rows.join(first, same).select(*[rows[k] for k in keys], "n", "v", F.explode(F.filter(spans, lambda s: F.col("v") <= s["high"])).alias("s"))
    inside = F.col("v") >= F.col("s.low")
    counted = met.groupBy(*keys, "n", F.col("s.i").alias("i"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v"))  # what lies below is the null row
    ranked = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.floor(F.col("n") * F.col("i") / bins)
    cuts = ranked.where(F.col("v").isNotNull() & (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cuts"))
    whole = F.when(F.size("cuts") == bins - 1, F.transform("cuts", lambda x: x["v"])).otherwise(F.raise_error(F.lit("a cut lies outside its bracket")))
    return cuts.select(*keys, whole.alias("cuts"))


#: Accuracy of the brackets' quantiles, and how far beyond its share a bracket reaches: twice the error.
_ACCURACY = 10_000
_SLACK = 2 / _ACCURACY


def bin_right(value: Column, cuts: Column) -> Column:
    """How many cuts are at or below the value."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def shuffled_number(df: DataFrame, item: str, seed: int, name: str) -> DataFrame:
    """Rows numbered from zero in the order of a seeded hash, without ordering all rows in one task.

    The hash's first digits make 4,096 even ranges; only their counts pass through one window.
    """
    hash_, part, size, start, own = (fresh(x, df) for x in ("hash", "range", "size", "before", "own"))
    marked = df.withColumn(hash_, seeded_hash(seed, item)).withColumn(part, F.substring(hash_, 1, 3))
    sizes = marked.groupBy(part).agg(F.count("*").alias(size))
    before = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(start))
    place = F.row_number().over(Window.partitionBy(part).orderBy(hash_, item)) - 1
    return marked.withColumn(own, place).join(before, part).withColumn(name, F.col(own) + F.col(start)).drop(hash_, part, own, start)


def batch_plan(examples: DataFrame, item: str, length: str, batch: int, ranks: int, budget: int, seed: int) -> DataFrame:
    """(step, rank, micro, place, item, length): items shuffled by hash, cut into batches, dealt and packed.

    Batches of ``batch`` items; the remainder is left out. In a batch items go to ranks in turn by falling length;
    a rank's items fill micro-batches while longest x count stays in the budget. As lengths fall, a micro-batch's
    longest is its first, so packing is a fold over one batch's few items.
    """
    steps = examples.agg(F.floor(F.count("*") / batch).alias("_steps"))  # one row
    numbered = shuffled_number(examples, item, seed, "_n").withColumn("step", F.floor(F.col("_n") / batch)).join(F.broadcast(steps)).where("step < _steps")
    dealt = numbered.withColumn("_by", F.row_number().over(Window.partitionBy("step").orderBy(F.desc(length), item)) - 1).withColumn("rank", F.col("_by") % ranks)
    share = dealt.groupBy("step", "rank").agg(F.sort_array(F.collect_list(F.struct("_by", F.col(length).alias("l"), F.col(item).alias("i")))).alias("items"))
    start = F.struct(F.lit(-1).alias("micro"), F.lit(0).cast("long").alias("longest"), F.lit(0).alias("n"), F.array().cast("array<struct<micro:int,place:int,i:long,l:long>>").alias("out"))

    def pack(s: Column, x: Column) -> Column:
        size = x["l"].cast("long")
        fits = (s["n"] > 0) & (s["longest"] * (s["n"] + 1) <= budget)
        micro = F.when(fits, s["micro"]).otherwise(s["micro"] + 1)
        place = F.when(fits, s["n"]).otherwise(0)
        row = F.struct(micro.alias("micro"), place.alias("place"), x["i"].cast("long").alias("i"), size.alias("l"))
        return F.struct(micro.alias("micro"), F.when(fits, s["longest"]).otherwise(size).alias("longest"), (place + 1).alias("n"), F.concat(s["out"], F.array(row)).alias("out"))

    packed = share.select("step", "rank", F.explode(F.aggregate("items", start, pack, lambda s: s["out"])).alias("x"))
    return packed.select("step", "rank", "x.micro", "x.place", F.col("x.i").alias(item), F.col("x.l").alias(length))
